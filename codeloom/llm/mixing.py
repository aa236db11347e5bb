"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the exponential key ``-ln(u) / weight`` from a hash of its
id; within a source the documents are taken in key order. A source whose target
exceeds its size repeats whole epochs first, and only the rest of the target is
selected by prefix sums over the sorted keys. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.llm.common import SPACE_WORD, materialize, running_total


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def exponential_key(id_col: Column, weight: Column, seed: int) -> Column:
    """-ln(u)/weight; u in (0, 1) comes from the top 53 bits of a hash of the id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def source_targets(totals: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """Targets of (source, source_size): ``share`` of all sizes split by weight, none above ``cap`` sizes.

    Sources take the weights in turn, in code point order, null last. Sharing the
    excess again until no target is above its cap is water-filling: with sources
    in order of cap/weight, the level is the largest of
    (total - caps so far) / (weights from here on).
    One row per source: these windows see the list of sources, never documents.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(cap))
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    whole = W.partitionBy()
    level = (
        ranked.withColumn("_total", F.sum("source_size").over(whole) * float(share))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_weights", F.sum("_w").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("_level", F.max((F.col("_total") - F.col("_caps")) / F.col("_weights")).over(whole))
    )
    return level.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.col("_level")).alias("target"))


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: list[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
) -> DataFrame:
    """Words that the mix takes of every document.

    ``docs`` has doc_id, text and source; other columns are ignored. ``quality``
    has (doc_id, weight), one positive weight for a document; 1.0 where it has none.

    Returns doc_id, size, source_size, target, taken and the E-S key. Defined
    results: null text is size 0; null source is a source of its own, last in
    order; null doc_id draws the key of null; repeated rows each count and each
    get a row; an empty table gives no rows. Equal keys are ordered by doc_id. The
    document on the budget line gives only as many words as the line leaves, so a
    source's taken words equal its target rounded down.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    if quality is not None:
        q = quality.groupBy(F.col("doc_id").alias("_q")).agg(F.avg("weight").alias("_weight"))
        sized = sized.join(q, sized["doc_id"] == q["_q"], "left").drop("_q")
        sized = sized.withColumn("_weight", F.coalesce("_weight", F.lit(1.0)))
    else:
        sized = sized.withColumn("_weight", F.lit(1.0))
    keyed = materialize(sized.withColumn("key", exponential_key(F.col("doc_id"), F.col("_weight"), seed)).drop("_weight"), "mix-keys")

    totals = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, list(weights), share, cap).withColumnRenamed("source", "_source")
    before = running_total(keyed, "source", ["key", "doc_id", "size"], "size", "_before")
    # One row per source; the planner broadcasts it below its own size threshold.
    mixed = before.join(targets, before["source"].eqNullSafe(targets["_source"]), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target")).cast("long") - epochs * F.col("source_size")
    partial = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_before")))
    return mixed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + partial).alias("taken"), "key")
