"""Impact of a change, and the selection of what to read under a token budget.

Evidence rows are united, added up by file and cut at the edge; every cut reports
what it left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.scratch import materialize

# Score of each kind of evidence: fixed values.
EVIDENCE_SCORES = {
    "seed_file": 100,
    "seed_definition": 90,
    "seed_file_symbol": 80,
    "direct_caller": 70,
    "type_relation_source": 68,
    "callee_target": 65,
    "dependency_target": 60,
    "dependency_source": 55,
    "callee_source": 45,
    "text_reference": 40,
}
#: First score, step by depth and floor of walked evidence.
CALLER_DECAY = (70, 15, 20)
IMPORTER_DECAY = (60, 10, 20)
MOST_REASONS = 8
LEAST_BUDGET = 500


def evidence(rows: DataFrame, kind: str, file: str = "file") -> DataFrame:
    """(file, reason, score) of rows that are evidence of one kind."""
    return rows.select(F.col(file).alias("file"), F.lit(kind).alias("reason"), F.lit(EVIDENCE_SCORES[kind]).cast("long").alias("score"))


def decayed(walked: DataFrame, kind: str, decay: tuple[int, int, int], file: str = "node") -> DataFrame:
    """(file, reason, score) of walked nodes: the score falls with depth to a floor."""
    first, step, floor = decay
    score = F.greatest(F.lit(floor), F.lit(first) - (F.col("depth") - 1) * step)
    return walked.select(F.col(file).alias("file"), F.concat(F.lit(kind + "_depth_"), F.col("depth").cast("string")).alias("reason"), score.cast("long").alias("score"))


def impact_scores(parts: list[DataFrame]) -> DataFrame:
    """(file, score, evidence, reasons): scores add up; at most 8 reasons, in order.

    Evidence is first summed by file and reason, so what is gathered for a file is one
    row a reason, however often the reason occurs.
    """
    united = reduce(DataFrame.unionByName, parts)
    by_reason = united.groupBy("file", "reason").agg(F.sum("score").alias("_score"), F.count("*").alias("_n"))
    return by_reason.groupBy("file").agg(
        F.sum("_score").alias("score"), F.sum("_n").alias("evidence"), F.slice(F.sort_array(F.collect_set("reason")), 1, MOST_REASONS).alias("reasons")
    )


def impact_risk(scores: DataFrame, depth: int = 1) -> DataFrame:
    """One row: files, top score, risk. High from 20 files, a score of 300 or depth 4; medium from 6, 120 or 2."""
    one = scores.agg(F.count("*").alias("files"), F.coalesce(F.max("score"), F.lit(0)).alias("max_score"))
    risk = (
        F.when((F.col("files") >= 20) | (F.col("max_score") >= 300) | F.lit(depth >= 4), "high")
        .when((F.col("files") >= 6) | (F.col("max_score") >= 120) | F.lit(depth >= 2), "medium")
        .otherwise("low")
    )
    return one.withColumn("max_depth", F.lit(depth)).withColumn("risk", risk)


def source_mix(parts: DataFrame) -> DataFrame:
    """(file, source, n) of evidence rows (file, source)."""
    return parts.groupBy("file", "source").agg(F.count("*").alias("n"))


def merge_ranges(ranges: DataFrame, gap: int = 1, more: tuple[Column, ...] = ()) -> DataFrame:
    """Islands of (file, start_line, end_line): ranges that overlap or lie within ``gap`` lines become one.

    Ranges are dealt by (file, start_line), so that a hot file spreads over tasks. A slice
    takes over the last line that the slices before it reach in the file, and the number
    of islands that they open; one row for each file and slice carries both. ``more`` are
    aggregates of other columns over an island.
    """
    slices = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranges.repartitionByRange(slices, "file", "start_line", "end_line").withColumn("_slice", F.spark_partition_id())
    ranged = materialize(ranged)
    before = W.partitionBy("file").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("_slice", "file").orderBy("start_line", "end_line")
    reach = ranged.groupBy("file", "_slice").agg(F.max("end_line").alias("_max"))
    reach = reach.select("file", "_slice", F.max("_max").over(before).alias("_ahead"))
    local = ranged.join(reach, ["file", "_slice"])
    upto = F.greatest(F.max("end_line").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.col("_ahead"))
    marked = local.withColumn("_new", F.when(F.col("start_line") > F.coalesce(upto, F.lit(-1)) + gap, 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    opened = marked.groupBy("file", "_slice").agg(F.sum("_new").alias("_n"))
    opened = opened.select("file", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    islands = marked.join(opened, ["file", "_slice"]).groupBy("file", (F.col("_island") + F.col("_offset")).alias("_island"))
    return islands.agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("merged"), *more).drop("_island")


def trim_ranges(ranges: DataFrame, most_lines: int) -> DataFrame:
    """Ranges cut to their first ``most_lines`` lines."""
    return ranges.withColumn("end_line", F.least("end_line", F.col("start_line") + most_lines - 1))


def budget_cut(candidates: DataFrame, budget: int) -> DataFrame:
    """Candidates (rank columns score, file, tokens) with rank, running_tokens and selected.

    The longest prefix of the ranking that fits is selected; a budget below the least
    one is raised to it. All candidates are ranked: they are dealt by ranges of the
    ranking, counted and summed inside a range, and offset by the ranges before it.
    """
    limit = max(budget, LEAST_BUDGET)
    order = [F.desc("score"), F.asc("file"), *([F.asc("start_line")] if "start_line" in candidates.columns else [])]
    slices = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(candidates.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sums = ranged.groupBy("_slice").agg(F.count("*").alias("_n"), F.sum("tokens").alias("_sum"))
    offsets = sums.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"), F.sum("_sum").over(before).alias("_offset"))
    inside = W.partitionBy("_slice").orderBy(*order)
    local = ranged.withColumn("rank", F.row_number().over(inside)).withColumn("running_tokens", F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    own = F.col("running_tokens")
    ranked = (
        local.join(F.broadcast(offsets), "_slice")
        .withColumn("rank", (F.col("rank") + F.col("_ahead")).cast("int"))
        .withColumn("running_tokens", F.coalesce(own + F.col("_offset"), own, F.col("_offset")))
        .drop("_slice", "_ahead", "_offset")
    )
    return ranked.withColumn("selected", F.col("running_tokens") <= limit)


def omitted(candidates: DataFrame, selected: DataFrame, key: str = "file", most: int = 8) -> DataFrame:
    """The best candidates that were not selected."""
    return candidates.join(selected.select(key), key, "left_anti").orderBy(F.desc("score"), key).limit(most)


def continuation(counts: DataFrame) -> DataFrame:
    """Status and next step of (candidates, selected, raised, exhausted)."""
    status = (
        F.when(F.col("candidates") == 0, "no_candidates")
        .when(F.col("raised"), "minimum_budget_applied")
        .when(F.col("exhausted"), "token_budget_exhausted")
        .when(F.col("selected") < F.col("candidates"), "candidates_omitted")
        .otherwise("complete")
    )
    action = F.when(F.col("selected") < F.col("candidates"), "raise_budget_to_4000").when(F.col("candidates") == 0, "name_a_seed").otherwise("read_selected")
    return counts.withColumn("status", status).withColumn("next_action", action)


def read_less(baseline: DataFrame) -> DataFrame:
    """Lines avoided of (baseline, selected): never below zero; percent and ratio with one decimal or n/a."""
    b, s = F.col("baseline"), F.col("selected")
    avoided = F.greatest(b - s, F.lit(0))
    return baseline.withColumn("avoided", avoided).withColumn(
        "percent", F.when(b > 0, F.format_string("%.1f", avoided * 100.0 / b)).otherwise("n/a")
    ).withColumn("ratio", F.when(s > 0, F.format_string("%.1f", b * 1.0 / s)).otherwise("n/a"))


#: Follow-up for the source that gave most of a file's evidence.
FOLLOW_UP = {
    "seed_file": ("inspect_seed", "outline"),
    "symbol_definition": ("read_definition", "find_references"),
    "type_relation": ("check_contract", "dependency_graph"),
    "call_graph": ("follow_calls", "callers"),
    "reference": ("check_usage", "find_references"),
    "semantic": ("confirm_match", "semantic_search"),
    "dependency": ("check_import", "dependency_graph"),
    "task_location": ("inspect_location", "outline"),
    "fallback": ("confirm_match", "symbol_search"),
}


def reading_plan(mix: DataFrame) -> DataFrame:
    """(file, source, focus, tool): the dominant source of each file, ties by name, and what follows from it."""
    top = mix.groupBy("file").agg(F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("source"))
    table = mix.sparkSession.createDataFrame([(k, *v) for k, v in FOLLOW_UP.items()], "source string, focus string, tool string")
    return top.join(F.broadcast(table), "source", "left").select("file", "source", "focus", "tool")


def infer_seed(task: DataFrame) -> DataFrame:
    """Strategy and seed of (explicit, task_path, path_indexed, task_match, entrypoint, source_file): the first that is there."""
    c = F.col
    strategy = (
        F.when(c("explicit").isNotNull(), "explicit")
        .when(c("task_path").isNotNull() & c("path_indexed"), "auto_task_path")
        .when(c("task_path").isNotNull(), "auto_task_path_unindexed")
        .when(c("task_match").isNotNull(), "auto_task_match")
        .when(c("entrypoint").isNotNull(), "auto_entrypoint")
        .when(c("source_file").isNotNull(), "auto_source_fallback")
        .otherwise("auto_no_seed")
    )
    return task.withColumn("strategy", strategy).withColumn("seed", F.coalesce("explicit", "task_path", "task_match", "entrypoint", "source_file"))


def agreement(routes: DataFrame) -> DataFrame:
    """How an external backend's candidates agree with a route (first_file, selected, backend)."""
    first, own, other = F.col("first_file"), F.col("selected"), F.col("backend")
    state = (
        F.when(other.isNull(), "no_backend")
        .when((F.size(other) == 0), "backend_without_candidates")
        .when(first.isNull(), "no_local_route")
        .when(F.element_at(other, 1) == first, "agree")
        .when(F.arrays_overlap(own, other), "overlap")
        .when(F.size(own) > 0, "conflict")
        .otherwise("backend_only")
    )
    return routes.withColumn("agreement", state).withColumn("common", F.coalesce(F.size(F.array_intersect(own, other)), F.lit(0)))
