"""Queries over what the tools are made of: scopes, seeds, ranges, evidence, paths, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import context, graph, planning, reports, resolve, semantic
from codeloom.operators.scratch import materialize, scratch_dir
from codeloom.plans import bindings as b
from codeloom.plans.registry import query
from codeloom.sources import records
from codeloom.sources.tree import Scope, language_of
from codeloom.streaming import tail


@query(
    f"""WITH {b.DEPENDENCIES}, f AS (SELECT * FROM deps WHERE language IN ('A', 'N') AND kind = 'O'), l AS (SELECT *, resolved_file IS NOT NULL AND NOT starts_with(resolved_file, 'node_modules/') AS here FROM f)
 SELECT count(*) AS edges, count(resolved_file) AS resolved, count(*) FILTER (here) AS "local", count(*) FILTER (NOT here) AS "external", count(*) FILTER (resolved_file IS NULL) AS unresolved,
 count(*) FILTER (kind = 'F') AS type_relation, count(DISTINCT CASE WHEN NOT here THEN target END) AS external_targets FROM l"""
)
def graph_summary_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return graph.summary(graph.filter_edges(b.dependencies(spark, sf), languages=["A", "N"], kinds=["O"]), relation_kind="F")


_ENDINGS = ("py", "ts", "tsx", "h", "hpp", "rs", "md", "sh", "cs", "mjs", "")


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(f".{x}" if x else "") for x in _ENDINGS]), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int"))
    return b.table(spark, sf, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/v1.2/f"), F.col("doc_id").cast("string"), ending).alias("path"))


_PATHS = f"""p AS (SELECT source || '/' || lang || '/v1.2/f' || doc_id || {list(f'.{x}' if x else '' for x in _ENDINGS)}[doc_id % {len(_ENDINGS)} + 1] AS path, doc_id % {len(_ENDINGS)} AS k FROM documents)"""


@query(f"WITH {_PATHS} SELECT path, ['python','typescript','tsx','c','cpp','rust',NULL,'bash','csharp','javascript',NULL][k + 1] AS language FROM p")
def file_languages(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("path", language_of(F.col("path")).alias("language"))


@query(
    f"""WITH {_PATHS} SELECT path FROM p WHERE (split_part(path, '/', 2) = 'en' OR (split_part(path, '/', 2) IN ('de', 'fr') AND (ends_with(path, '.py') OR ends_with(path, '.rs'))))
 AND NOT (split_part(path, '/', 2) = 'en' AND regexp_matches(path, '/f[0-9]*7[.]ts$'))"""
)
def scoped_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Include patterns with and without metacharacters, less exclude patterns."""
    sources = [r[0] for r in b.table(spark, sf, "documents").select("source").distinct().orderBy("source").collect()]
    scope = Scope(include=[f"{s}/en" for s in sources] + ["*/{de,fr}/**/*.py", "./**/de/v1.2/f*.rs", "*/fr/v?.[0-9]/*.rs"], exclude=["*/en/**/f*7.ts"])
    return _paths(spark, sf).filter(scope.condition(F.col("path")))


@query(
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'e' || doc_id END AS explicit, CASE WHEN doc_id % 5 = 0 THEN 'p' || doc_id END AS task_path, doc_id % 2 = 0 AS path_indexed,
  CASE WHEN doc_id % 3 = 0 THEN 'm' || doc_id END AS task_match, CASE WHEN doc_id % 4 = 0 THEN 'n' || doc_id END AS entrypoint, CASE WHEN doc_id % 11 <> 0 THEN 's' || doc_id END AS source_file FROM documents)
 SELECT doc_id, CASE WHEN explicit IS NOT NULL THEN 'explicit' WHEN task_path IS NOT NULL AND path_indexed THEN 'auto_task_path' WHEN task_path IS NOT NULL THEN 'auto_task_path_unindexed' WHEN task_match IS NOT NULL THEN 'auto_task_match'
  WHEN entrypoint IS NOT NULL THEN 'auto_entrypoint' WHEN source_file IS NOT NULL THEN 'auto_source_fallback' ELSE 'auto_no_seed' END AS strategy, coalesce(explicit, task_path, task_match, entrypoint, source_file) AS seed FROM t"""
)
def seed_inference(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    named = lambda p, c: F.when(c, F.concat(F.lit(p), d.cast("string")))
    rows = b.table(spark, sf, "documents").select(
        "doc_id", named("e", d % 7 == 0).alias("explicit"), named("p", d % 5 == 0).alias("task_path"), (d % 2 == 0).alias("path_indexed"), named("m", d % 3 == 0).alias("task_match"),
        named("n", d % 4 == 0).alias("entrypoint"), named("s", d % 11 != 0).alias("source_file"),
    )
    return planning.infer_seed(rows).select("doc_id", "strategy", "seed")


@query(
    f"""WITH RECURSIVE {b.WALK_EDGES}, reach AS (SELECT n_name AS start, n_name AS node, 0 AS depth FROM nation WHERE n_nationkey < 2
 UNION SELECT r.start, e.dst, r.depth + 1 FROM reach r JOIN edges e ON r.node = e.src WHERE r.depth < 3), best AS (SELECT start, node, min(depth) AS depth FROM reach WHERE depth > 0 GROUP BY 1, 2),
 level AS (SELECT start, node, depth FROM best UNION ALL SELECT n_name, n_name, 0 FROM nation WHERE n_nationkey < 2)
 SELECT x.start, x.node, CAST(x.depth AS INTEGER) AS depth, min(e.src) AS via FROM best x JOIN edges e ON e.dst = x.node JOIN level y ON y.start = x.start AND y.node = e.src AND y.depth = x.depth - 1 GROUP BY 1, 2, 3"""
)
def walked_paths(spark: SparkSession, sf: str) -> DataFrame:
    starts = b.table(spark, sf, "nation").filter("n_nationkey < 2").select(F.col("n_name").alias("start"))
    return resolve.walk_paths(b.walk_edges(spark, sf), starts, 3)


_RANGES = """r AS (SELECT source AS file, CAST((doc_id * 37) % 4000 + 1 AS BIGINT) AS start_line, CAST((doc_id * 37) % 4000 + 1 + n_chars % 60 AS BIGINT) AS end_line, lang AS source, CAST(n_chars % 50 AS INTEGER) AS base FROM documents),
 m AS (SELECT *, CASE WHEN start_line > coalesce(max(end_line) OVER (PARTITION BY file ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 THEN 1 ELSE 0 END AS fresh FROM r),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM m),
 i AS (SELECT file, min(start_line) AS start_line, least(max(end_line), min(start_line) + 119) AS end_line, max(base) AS base, array_to_string(list_sort(list_distinct(list(source) FILTER (source IS NOT NULL))), ',') AS sources FROM g GROUP BY file, island)"""


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    start = (F.col("doc_id") * 37) % 4000 + 1
    rows = b.table(spark, sf, "documents").select(
        F.col("source").alias("file"), start.alias("start_line"), (start + F.col("n_chars") % 60).alias("end_line"), F.col("lang").alias("source"), (F.col("n_chars") % 50).cast("int").alias("base")
    )
    files = rows.select("file", F.lit(100_000).cast("long").alias("line_count")).distinct()
    return context.candidates([rows], files, F.when(F.col("file") < "m", 5).otherwise(0))


@query(
    f"""WITH {_RANGES} SELECT file, start_line, end_line, sources, CAST(base + CASE WHEN file < 'm' THEN 5 ELSE 0 END AS INTEGER) AS score, end_line - start_line + 1 AS "lines", (end_line - start_line + 1) * 10 AS tokens FROM i"""
)
def context_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return _ranges(spark, sf).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {_RANGES} SELECT file, string_agg(start_line || '-' || end_line, ',' ORDER BY start_line) AS locations FROM i GROUP BY 1")
def range_locations(spark: SparkSession, sf: str) -> DataFrame:
    """The map of files to their ranges, a row for each of its entries."""
    return context.location_map(_ranges(spark, sf)).select(F.explode("locations").alias("file", "l")).select("file", F.array_join("l", ",").alias("locations"))


@query(
    """WITH c AS (SELECT conv_id, list(struct_pack(f := 'f/' || turn, s := turn) ORDER BY turn) AS l FROM conversations GROUP BY 1)
 SELECT conv_id, 'p' || conv_id AS provider, CAST(len(l) AS INTEGER) AS total, CAST(greatest(len(l) - 2, 0) AS INTEGER) AS omitted, array_to_string([x.f FOR x IN l[1:2]], ',') AS files, CAST(list_sum([x.s FOR x IN l[1:2]]) AS DOUBLE) AS score FROM c"""
)
def evidence_json(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence that is written as JSON and read again, cut to two candidates."""
    c = b.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn"))).alias("t"))
    rows = c.select("conv_id", F.transform("t", lambda x: F.struct(F.concat(F.lit("f/"), x["turn"].cast("string")).alias("file"), x["turn"].cast("double").alias("score"))).alias("candidates"), F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("provider"))
    texts = rows.select("conv_id", F.to_json(F.struct("provider", "candidates")).alias("json"))
    cut = records.cut_candidates(records.evidence_from(texts), 2)
    total = F.aggregate(F.col("candidates.score"), F.lit(0.0), lambda s, x: s + x)
    return cut.select("conv_id", "provider", "total", "omitted", F.array_join("candidates.file", ",").alias("files"), total.alias("score"))


@query("SELECT vec_id, CAST(256 AS INTEGER) AS bytes, unnest(range(0, 64)) AS place, round(CAST(unnest(embedding) AS DOUBLE), 5) AS value FROM embeddings")
def vector_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as bytes and read again."""
    e = b.table(spark, sf, "embeddings").select("vec_id", semantic.encode_vector("embedding").alias("blob"), F.size("embedding").cast("long").alias("n"))
    back = e.select("vec_id", F.length("blob").alias("bytes"), F.posexplode(semantic.decode_vector("blob", "n")).alias("place", "value"))
    return back.select("vec_id", "bytes", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 5).alias("value"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The events read as a stream, counted by hour with a watermark, and what its last state is."""
    events = b.table(spark, sf, "events")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counted = tail.event_counts(source).select("start", "event_type", "n", F.round("total", 2).alias("total"))
    kept: list[DataFrame] = []
    writer = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{scratch_dir(spark)}/stream-{id(kept)}-{spark.sparkContext.startTime}")
    writer.foreachBatch(lambda df, n: kept.append(materialize(df))).trigger(availableNow=True).start().awaitTermination()
    return kept[-1]


@query(
    """SELECT event_id, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS days, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds,
 CAST(isodow(ts) AS INTEGER) AS weekday, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events"""
)
def event_times(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return b.table(spark, sf, "events").select(
        "event_id", F.to_date("ts").alias("day"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("days"), F.unix_seconds(ts).alias("seconds"),
        (F.weekday("ts") + 1).alias("weekday"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"),
    )


_ROUTES = """r AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN 'f/' || doc_id % 10 END AS first_file, ['f/' || doc_id % 10, 'f/' || doc_id % 11] AS selected,
 CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN [] ELSE ['f/' || doc_id % 12, 'f/' || doc_id % 10] END AS candidates FROM documents),
 s AS (SELECT doc_id, coalesce(first_file, '') AS f, selected, coalesce(candidates, []) AS c FROM r),
 t AS (SELECT *, f <> '' AND len(c) > 0 AND f = c[1] AS matches_top, f <> '' AND list_contains(c, f) AS in_candidates, [x FOR x IN selected IF list_contains(c, x)] AS common FROM s),
 b AS (SELECT *, CASE WHEN matches_top THEN 'agree' WHEN in_candidates THEN 'overlap' ELSE 'conflict' END AS agreement FROM t)"""


def _bridge(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    f = lambda n: F.concat(F.lit("f/"), (d % n).cast("string"))
    candidates = F.when(d % 5 == 0, None).when(d % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(f(12), f(10)))
    return reports.bridge_reports(b.table(spark, sf, "documents").select("doc_id", F.when(d % 9 != 0, f(10)).alias("first_file"), F.array(f(10), f(11)).alias("selected"), candidates.alias("candidates")))


@query(
    f"""WITH {_ROUTES} SELECT doc_id, matches_top, in_candidates, array_to_string(common, ',') AS common_files, CAST(len(c) AS INTEGER) AS candidate_count, CAST(len(common) AS INTEGER) AS common_count,
 CASE WHEN len(c) > 0 THEN len(common)::DOUBLE / len(c) ELSE 0.0 END::DOUBLE AS ratio, agreement,
 CASE agreement WHEN 'agree' THEN 'read_selected_context' WHEN 'overlap' THEN 'read_selected_context_then_compare_backend_rank' ELSE 'compare_backend_route_before_edits' END AS recommended_action,
 CASE agreement WHEN 'agree' THEN 'use_agent_route_selected_context' WHEN 'overlap' THEN 'review_backend_order_vs_local_route' ELSE 'investigate_backend_local_conflict' END AS next_action FROM b"""
)
def bridge_report(spark: SparkSession, sf: str) -> DataFrame:
    return _bridge(spark, sf).withColumn("common_files", F.array_join("common_files", ",")).drop("first_file", "selected", "candidates")


_STATUS = "q AS (SELECT *, CASE WHEN matches_top THEN 'pass' ELSE 'warn' END AS status FROM b)"


@query(
    f"""WITH {_ROUTES}, {_STATUS}, o AS (SELECT count(*) AS reports, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (agreement = 'agree') AS agree, count(*) FILTER (agreement = 'overlap') AS overlap,
  count(*) FILTER (agreement = 'conflict') AS conflict, count(*) FILTER (agreement = 'backend_only') AS backend_only, count(*) FILTER (agreement = 'no_local_route') AS no_local_route,
  count(*) FILTER (status <> 'pass' OR agreement <> 'agree') AS conflicts, CAST(sum(len(common)) AS BIGINT) AS common, CAST(sum(len(c)) AS BIGINT) AS candidates FROM q)
 SELECT *, floor(agree * 10000::DOUBLE / reports) / 100 AS rate, floor(common * 10000::DOUBLE / candidates) / 100 AS candidate_rate, CASE WHEN conflicts > 0 THEN 'needs_review' ELSE 'pass' END AS status,
 CASE WHEN conflict > 0 THEN 'review_backend_local_conflicts' WHEN overlap > 0 THEN 'review_backend_order_vs_local_route' ELSE 'run_more_real_backend_tasks' END AS next_action FROM o"""
)
def bridge_decision(spark: SparkSession, sf: str) -> DataFrame:
    return reports.bridge_decision(_bridge(spark, sf).withColumn("status", F.when(F.col("matches_top"), "pass").otherwise("warn")), 3, 50.0)


@query(f"WITH {_ROUTES}, {_STATUS} SELECT doc_id, agreement, status FROM q WHERE status <> 'pass' OR agreement <> 'agree'")
def bridge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.conflicts(_bridge(spark, sf).withColumn("status", F.when(F.col("matches_top"), "pass").otherwise("warn"))).select("doc_id", "agreement", "status")


_TRIALS = """t AS (SELECT doc_id, lang, CASE WHEN quality = 1 THEN 'useful' WHEN toxic = 1 THEN 'route_miss' ELSE 'route_near_miss' END AS outcome, CASE WHEN doc_id % 17 <> 0 THEN n_chars % 100 END AS quality FROM labels JOIN documents USING (doc_id))"""


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    joined = b.table(spark, sf, "labels").join(b.table(spark, sf, "documents"), "doc_id")
    outcome = F.when(F.col("quality") == 1, "useful").when(F.col("toxic") == 1, "route_miss").otherwise("route_near_miss")
    return joined.select("doc_id", outcome.alias("outcome"), F.when(F.col("doc_id") % 17 != 0, F.col("n_chars") % 100).alias("quality"))


@query(
    f"""WITH {_TRIALS} SELECT count(*) AS reports, count(*) FILTER (outcome = 'needs_triage') AS needs_triage, count(*) FILTER (outcome = 'workflow_friction') AS workflow_friction,
 count(*) FILTER (quality IS NULL OR quality < 20) AS route_quality_below_threshold, count(*) FILTER (outcome = 'route_miss') AS route_miss, count(*) FILTER (outcome = 'overtrust_risk') AS overtrust_risk,
 count(*) FILTER (outcome = 'route_near_miss') AS route_near_miss, 'quality_gate_failed' AS status, 'fix_low_quality_routes' AS next_action, 'route_quality_below_threshold' AS about FROM t"""
)
def trial_decision(spark: SparkSession, sf: str) -> DataFrame:
    return reports.trial_decision(_trials(spark, sf), 3, 20)


@query(f"WITH {_TRIALS} SELECT doc_id, outcome, quality FROM t WHERE quality IS NULL OR quality < 20")
def trial_priorities(spark: SparkSession, sf: str) -> DataFrame:
    trials = _trials(spark, sf)
    return reports.priority_reports(trials, reports.trial_decision(trials, 3, 20), 20)
