"""Queries over scalar rules, snapshots, reports and plans that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import names
from codeloom.operators import graph, incremental, lookup, planning, reports, resolve, semantic
from codeloom.plans import bindings as b
from codeloom.plans.registry import query


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS lines FROM documents")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents").select("doc_id", names.line_count(F.col("text")).alias("lines"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '/x' WHEN 1 THEN 'x' WHEN 2 THEN source WHEN 3 THEN 'c' ELSE source || '/b' END AS path FROM documents"""
)
def normalized_paths(spark: SparkSession, sf: str) -> DataFrame:
    tails = F.array(*[F.lit(x) for x in ("/./x", "/../x", "/a/..", "/../../c", "//b/")])
    path = F.concat("source", F.element_at(tails, (F.col("doc_id") % 5 + 1).cast("int")))
    return b.table(spark, sf, "documents").select("doc_id", names.normalize_path(path).alias("path"))


@query("SELECT doc_id, floor(n_chars * 10000::DOUBLE / (n_chars + 7)) / 100 AS percent FROM documents")
def floor_percents(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents").select("doc_id", names.floor_percent(F.col("n_chars"), F.col("n_chars") + 7).alias("percent"))


@query(
    f"""WITH {b.DEPENDENCIES} SELECT kind, language, count(*) AS n, count(resolved_file) AS resolved FROM deps WHERE source_file IN ('order/1', 'order/7', 'order/32') OR resolved_file IN ('order/1', 'order/7', 'order/32') GROUP BY 1, 2"""
)
def graph_of_files(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.filter_edges(b.dependencies(spark, sf), files=["order/1", "order/7", "order/32"])
    return found.groupBy("kind", "language").agg(F.count("*").alias("n"), F.count("resolved_file").alias("resolved"))


@query(
    """WITH c AS (SELECT doc_id, 'doc/' || doc_id AS file FROM documents), old AS (SELECT file FROM c WHERE doc_id % 3 = 0), fresh AS (SELECT 'new/' || doc_id AS file FROM c WHERE doc_id % 6 = 0)
 SELECT file FROM c WHERE file NOT IN (SELECT file FROM old) UNION ALL SELECT file FROM fresh"""
)
def replaced_children(spark: SparkSession, sf: str) -> DataFrame:
    d = b.table(spark, sf, "documents")
    stored = d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"))
    changed = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"))
    new = d.filter("doc_id % 6 = 0").select(F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("file"))
    return incremental.replace_children(stored, new, "file", changed)


@query(
    f"""WITH {b.STORED}, {b.DESIRED} SELECT s.file, s.start_line, s.end_line FROM stored s JOIN desired d ON s.file = d.file AND s.start_line = d.start_line AND s.end_line = d.end_line AND s.content_hash = d.content_hash"""
)
def kept_vectors(spark: SparkSession, sf: str) -> DataFrame:
    stored, desired = b.chunk_sides(spark, sf)
    return incremental.kept_vectors(stored.select(*incremental.CHUNK_KEY), incremental.chunk_diff(stored, desired))


@query("SELECT (SELECT count(*) FROM documents) AS chunks, count(*) FILTER (label < 5) AS vectors, count(*) FILTER (label < 5) - 3 AS reused FROM embeddings")
def vector_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = b.table(spark, sf, "embeddings").select(F.lit("local-hash").alias("provider"), F.when(F.col("label") < 5, "m").otherwise("n").alias("model"))
    return semantic.vector_counts(b.table(spark, sf, "documents"), e, "local-hash", "m", 3)


@query(
    f"""WITH {b.FILES}, r AS (SELECT path, sha256(path || chr(0) || coalesce(CASE WHEN id % 9 <> 0 THEN hash END, 'missing')) AS d, substr(sha256(path), 1, 3) AS bucket FROM files),
 k AS (SELECT bucket, sha256(string_agg(d, chr(0) ORDER BY path)) AS d FROM r GROUP BY 1) SELECT sha256('import' || chr(0) || 'node' || chr(0) || string_agg(d, chr(0) ORDER BY bucket)) AS fingerprint FROM k"""
)
def resolution_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    f = b.files(spark, sf).select("path", F.when(F.col("id") % 9 != 0, F.col("hash")).alias("hash"))
    return incremental.fingerprint(f, ["import", "node"])


@query(
    f"""WITH {b.CALLS}, w AS (SELECT id AS call_id, 'svc/' || (id % 4) AS found FROM calls WHERE id % 5 = 0)
 SELECT c.id, coalesce(callee_file, found) AS callee_file, CASE WHEN found IS NOT NULL THEN greatest(confidence, 0.68) ELSE confidence END::DOUBLE AS confidence FROM calls c LEFT JOIN w ON c.id = w.call_id"""
)
def applied_winners(spark: SparkSession, sf: str) -> DataFrame:
    c = b.calls(spark, sf)
    winners = c.filter("id % 5 = 0").select(F.col("id").alias("call_id"), F.concat(F.lit("svc/"), (F.col("id") % 4).cast("string")).alias("callee_file"))
    return resolve.apply_winners(c, winners, 0.68).select("id", "callee_file", "confidence")


@query(
    f"""WITH {b.CALLS}, o AS (SELECT *, CASE WHEN id % 2 = 0 THEN callee_file ELSE 'other' END AS own FROM calls)
 SELECT id, CASE WHEN callee_file IS NOT NULL AND callee_file = own THEN callee_file END AS callee_file, CASE WHEN callee_file IS NOT NULL AND callee_file <> own THEN 0.55 ELSE confidence END::DOUBLE AS confidence FROM o"""
)
def reset_calls(spark: SparkSession, sf: str) -> DataFrame:
    c = b.calls(spark, sf).withColumn("source_file_id", F.col("id"))
    own = c.select("id", F.when(F.col("id") % 2 == 0, F.col("callee_file")).otherwise("other").alias("path"))
    return resolve.reset_calls(c, own).select("id", "callee_file", "confidence")


@query(
    """WITH m AS (SELECT 'file/' || (conv_id * 31 + turn * 7) % 400 AS file, CASE role WHEN 'user' THEN 'call_graph' WHEN 'assistant' THEN 'reference' ELSE 'dependency' END AS source FROM conversations),
 n AS (SELECT file, source, count(*) AS n FROM m GROUP BY 1, 2), r AS (SELECT file, source, row_number() OVER (PARTITION BY file ORDER BY n DESC, source) AS k FROM n)
 SELECT file, source, CASE source WHEN 'call_graph' THEN 'follow_calls' WHEN 'reference' THEN 'check_usage' ELSE 'check_import' END AS focus,
 CASE source WHEN 'call_graph' THEN 'callers' WHEN 'reference' THEN 'find_references' ELSE 'dependency_graph' END AS tool FROM r WHERE k = 1"""
)
def reading_plan(spark: SparkSession, sf: str) -> DataFrame:
    c = b.table(spark, sf, "conversations")
    source = F.when(F.col("role") == "user", "call_graph").when(F.col("role") == "assistant", "reference").otherwise("dependency")
    rows = c.select(F.concat(F.lit("file/"), ((F.col("conv_id") * 31 + F.col("turn") * 7) % 400).cast("string")).alias("file"), source.alias("source"))
    return planning.reading_plan(planning.source_mix(rows))


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'f/' || doc_id % 10 END AS first_file, ['f/' || doc_id % 10, 'f/' || doc_id % 11] AS selected,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN [] ELSE ['f/' || doc_id % 12, 'f/' || doc_id % 13] END AS backend FROM documents)
 SELECT doc_id, CASE WHEN backend IS NULL THEN 'no_backend' WHEN len(backend) = 0 THEN 'backend_without_candidates' WHEN first_file IS NULL THEN 'no_local_route' WHEN backend[1] = first_file THEN 'agree'
  WHEN list_has_any(selected, backend) THEN 'overlap' ELSE 'conflict' END AS agreement, CAST(coalesce(len(list_distinct(list_intersect(selected, backend))), 0) AS INTEGER) AS common FROM r"""
)
def backend_agreement(spark: SparkSession, sf: str) -> DataFrame:
    f = lambda n: F.concat(F.lit("f/"), (F.col("doc_id") % n).cast("string"))
    backend = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(f(12), f(13)))
    routes = b.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, f(10)).alias("first_file"), F.array(f(10), f(11)).alias("selected"), backend.alias("backend"))
    return planning.agreement(routes).select("doc_id", "agreement", "common")


@query(
    """WITH e AS (SELECT doc_id, 'f/' || doc_id % 4 AS want, CASE WHEN doc_id % 3 = 0 THEN 'explicit' END AS strategy FROM documents), a AS (SELECT doc_id, 'f/' || doc_id % 8 AS got, CASE WHEN doc_id % 2 = 0 THEN 'explicit' ELSE 'auto' END AS strategy FROM documents WHERE doc_id % 10 <> 9)
 SELECT CAST(e.doc_id AS VARCHAR) AS task, CASE WHEN want = got AND (e.strategy IS NULL OR e.strategy = a.strategy) THEN 'pass' ELSE 'fail' END AS status FROM e LEFT JOIN a USING (doc_id)"""
)
def expectation_status(spark: SparkSession, sf: str) -> DataFrame:
    d = b.table(spark, sf, "documents")
    task, f = F.col("doc_id").cast("string").alias("task"), lambda n: F.concat(F.lit("f/"), (F.col("doc_id") % n).cast("string")).alias("first_file")
    null = F.lit(None).cast("string").alias("seed")
    expected = d.select(task, f(4), F.when(F.col("doc_id") % 3 == 0, "explicit").alias("strategy"), null)
    actual = d.filter("doc_id % 10 <> 9").select(task, f(8), F.when(F.col("doc_id") % 2 == 0, "explicit").otherwise("auto").alias("strategy"), null)
    return reports.expectation_status(expected, actual)


@query(
    """WITH c AS (SELECT doc_id % 5 AS candidates, least(doc_id % 5, doc_id % 3) AS selected, doc_id % 11 = 0 AS raised, doc_id % 13 = 0 AS exhausted, doc_id FROM documents)
 SELECT doc_id, CASE WHEN candidates = 0 THEN 'no_candidates' WHEN raised THEN 'minimum_budget_applied' WHEN exhausted THEN 'token_budget_exhausted' WHEN selected < candidates THEN 'candidates_omitted' ELSE 'complete' END AS status,
 CASE WHEN selected < candidates THEN 'raise_budget_to_4000' WHEN candidates = 0 THEN 'name_a_seed' ELSE 'read_selected' END AS next_action FROM c"""
)
def continuation(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    counts = b.table(spark, sf, "documents").select("doc_id", (d % 5).alias("candidates"), F.least(d % 5, d % 3).alias("selected"), (d % 11 == 0).alias("raised"), (d % 13 == 0).alias("exhausted"))
    return planning.continuation(counts).select("doc_id", "status", "next_action")


@query(
    """WITH r AS (SELECT source AS repository, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS lines, CAST(sum(n_chars) // 50 AS BIGINT) AS tokens FROM documents GROUP BY 1)
 SELECT count(*) AS repositories, CAST(sum(files) AS BIGINT) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS most_tokens, count(*) FILTER (files < 5 OR tokens > 500) AS failures FROM r"""
)
def benchmark_totals(spark: SparkSession, sf: str) -> DataFrame:
    own = b.table(spark, sf, "documents").groupBy(F.col("source").alias("repository")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("lines"))
    return reports.benchmark_totals(own.withColumn("tokens", F.floor(F.col("lines") / 50)), least_files=5, most_tokens=500)


@query(
    f"""WITH {b.CHUNKS}, t AS (SELECT file, max(end_line) AS last, count(*) AS n FROM chunks GROUP BY 1) SELECT file, CAST(1 AS BIGINT) AS start_line, CAST(least(last, 12) AS BIGINT) AS end_line FROM t"""
)
def trimmed_ranges(spark: SparkSession, sf: str) -> DataFrame:
    merged = planning.merge_ranges(b.chunks(spark, sf).select("file", "start_line", "end_line"))
    return planning.trim_ranges(merged, 12).select("file", "start_line", "end_line")


@query("SELECT doc_id, regexp_extract(text, '([a-z]+)', 1) AS word, strpos(lower(text), 'the') AS at FROM documents WHERE contains(lower(text), 'the')")
def first_words(spark: SparkSession, sf: str) -> DataFrame:
    d = b.table(spark, sf, "documents").filter(F.instr(F.lower("text"), "the") > 0)
    return d.select("doc_id", F.regexp_extract("text", "([a-z]+)", 1).alias("word"), F.instr(F.lower("text"), "the").cast("long").alias("at"))


@query(
    f"""WITH {b.CHUNKS}, w AS (SELECT unnest(['find', 'thing', 'routing', 'route', 'router', 'routes']) AS word) SELECT file, start_line FROM chunks
 WHERE EXISTS (SELECT 1 FROM w WHERE contains(lower(text), word)) ORDER BY file, start_line LIMIT 100"""
)
def task_terms_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that any term of a task occurs in."""
    from codeloom.api import task_terms

    return lookup.chunks_matching(b.chunks(spark, sf), task_terms("find the thing in routing"), 100).select("file", "start_line")
