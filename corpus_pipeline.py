"""Corpus pipeline: five stages from raw documents to a mix with target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
that they were given.

Decisions are about rows, not about doc_ids: a row is known by its doc_id, which may be
null or repeated, together with its text. Rows alike in both get the same decision,
except that near-dedup keeps only one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialize
from codeloom.llm.decontaminate import decontaminate
from codeloom.llm.langid import UNDETERMINED, detect_languages, held_out, train_languages
from codeloom.llm.mixing import mix_sources
from codeloom.llm.queries import quality_weight
from codeloom.llm.simhash import near_duplicates
from codeloom.llm.suffix_dedup import remove_repeats

#: A document is rejected if less than this share of its letters is in its language.
LEAST_SHARE = 0.5


def _digest() -> Column:
    return F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-" * 32))


def _key(doc_id: Column, digest: Column) -> Column:
    """What a row is known by; a null doc_id differs from every other one."""
    return F.concat(F.when(doc_id.isNull(), "0").otherwise("1"), digest, F.coalesce(doc_id.cast("string"), F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs`` with the row's key for its doc_id."""
    return docs.select(_key(F.col("doc_id"), _digest()).alias("doc_id"), "text")


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _drop(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``decided`` (key)."""
    name = _free(docs, "_gone")
    gone = decided.select(F.col("key").alias(name))
    return docs.join(gone, _key(docs["doc_id"], F.coalesce(F.md5(docs["text"].cast("binary")), F.lit("-" * 32))) == gone[name], "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without letters, and those in no language for the most part, go; others of their doc_id stay.

    Null, empty and letterless texts go; letters of a script that no learned language has
    count for none. A null doc_id is a doc_id like any other; a null lang teaches nothing;
    rows alike in doc_id and text get the same decision, however often they occur; very
    long texts are labelled whole; all columns of ``docs``, of whatever name, stay as they
    are; an empty table gives no rows. Without any labelled row nothing is told and all go.
    """
    model = train_languages(docs.filter(~held_out()))
    found = detect_languages(_keyed(docs), model, spans=False)
    gone = found.filter((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < LEAST_SHARE))
    return _drop(docs, materialize(gone.select(F.col("doc_id").alias("key")), "rejected"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of the smallest doc_id, a null one coming last.

    Of several texts under that doc_id the one with the smallest MD5 stays, and of rows
    alike in doc_id and text any one. Null and empty texts have no words and form one
    group, of which one row stays; very long texts are hashed whole; all columns of
    ``docs``, of whatever name, stay as they are; an empty table gives no rows.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), _digest().alias("digest"))
    found = near_duplicates(docs.select(row.alias("doc_id"), "text"))
    key = _key(F.col("doc_id.id"), F.col("doc_id.digest"))
    first = _key(F.col("component_id.id"), F.col("component_id.digest"))
    found = materialize(found.select(key.alias("key"), (key == first).alias("stays")), "found")
    left = _drop(docs, found.filter("not stays"))
    again = materialize(found.filter("stays").groupBy("key").count().filter("count > 1").select("key"), "repeated")
    if again.isEmpty():
        return left
    name = _free(docs, "_row")
    marked = left.withColumn(name, _key(F.col("doc_id"), _digest()))
    once = marked.join(again.select(F.col("key").alias(name)), name, "left_semi").dropDuplicates([name])
    return _drop(left, again).unionByName(once.drop(name))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier are cut; n_chars is counted again where something was cut.

    No row goes. Null texts stay null, texts under 100 bytes stay whole, very long ones are
    cut whole; a null doc_id comes before all others, and of rows alike in doc_id and text
    the first is kept whole; the other columns of ``docs``, of whatever name, stay as they
    are; an empty table gives no rows.
    """
    cut = remove_repeats(docs, texts=True)
    if "n_chars" not in docs.columns:
        return cut.select(*[F.col(f"`{c}`") for c in docs.columns])
    was_cut = F.col("n_removed_cut" if "n_removed" in docs.columns else "n_removed") > 0
    n_chars = F.when(was_cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark window go; others of their doc_id stay.

    Items of null id count like any other, items without words have no window. Null and
    empty texts contain none; rows alike in doc_id and text, null doc_ids included, get
    the same decision; very long texts are looked at whole; all columns of ``docs``, of
    whatever name, stay as they are; an empty table gives no rows.
    """
    found = decontaminate(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _drop(docs, materialize(found.filter("contaminated").select(F.col("doc_id").alias("key")), "contaminated"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each row the mix takes, one result row for each row of ``docs``.

    Null texts have size 0 and give nothing; a null source is a source of its own, the
    last; ties of keys go by doc_id and size, so reruns agree; rows that repeat are taken
    each for itself; labels that repeat a doc_id weigh by their average and those without
    a quality 1; other columns of ``docs`` do not pass on; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix_sources(docs, labels.select("doc_id", quality_weight().alias("weight")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Fingerprints, language models and suffix sorting are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
