"""Queries over the code graph: pages, summaries, overviews, lookups, joins, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.names import path_role
from codeloom.operators import arms, graph, lookup, overview, resolve
from codeloom.plans import bindings as b
from codeloom.plans.registry import query

_FILTER = "filtered AS (SELECT * FROM deps WHERE language IN ('A', 'N') AND kind = 'O')"
_LOCAL = "(resolved_file IS NOT NULL AND NOT starts_with(resolved_file, 'node_modules/'))"


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return graph.filter_edges(b.dependencies(spark, sf), languages=["A", "N"], kinds=["O"])


@query(
    f"""WITH {b.DEPENDENCIES}, {_FILTER} SELECT source_file, target, resolved_file, kind, language, line, (SELECT count(*) FROM filtered) > 510 AS has_more
 FROM filtered ORDER BY source_file, line, target, resolved_file NULLS FIRST, kind, language LIMIT 500 OFFSET 10"""
)
def graph_page(spark: SparkSession, sf: str) -> DataFrame:
    return graph.page(_filtered(spark, sf), list(graph.EDGE_ORDER), 500, 10)


@query(
    f"""WITH {b.DEPENDENCIES} SELECT count(*) AS edges, count(resolved_file) AS resolved, count(*) FILTER ({_LOCAL}) AS "local",
 count(*) - count(*) FILTER ({_LOCAL}) AS "external", count(*) FILTER (resolved_file IS NULL) AS unresolved, count(*) FILTER (kind = 'F') AS type_relation,
 count(DISTINCT CASE WHEN NOT {_LOCAL} THEN target END) AS external_targets FROM deps"""
)
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.summary(b.dependencies(spark, sf), relation_kind="F")


@query(f"WITH {b.DEPENDENCIES}, {_FILTER} SELECT count(*) AS nodes FROM (SELECT source_file FROM filtered UNION SELECT target FROM filtered)")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.node_count(_filtered(spark, sf))


@query(f"WITH {b.DEPENDENCIES} SELECT source_file AS source_file, count(*) AS n FROM deps GROUP BY 1 ORDER BY n DESC, source_file LIMIT 12")
def graph_top_sources(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top(b.dependencies(spark, sf), "source_file", "source_file")


@query(f"WITH {b.DEPENDENCIES} SELECT target, count(*) AS n FROM deps GROUP BY 1 ORDER BY n DESC, target LIMIT 12")
def graph_top_targets(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top(b.dependencies(spark, sf), "target", "target")


@query(f"WITH {b.DEPENDENCIES} SELECT target, count(*) AS n FROM deps WHERE NOT {_LOCAL} GROUP BY 1 ORDER BY n DESC, target LIMIT 12")
def graph_top_external(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_external(b.dependencies(spark, sf))


@query(f"WITH {b.DEPENDENCIES} SELECT target, count(*) AS n FROM deps WHERE kind = 'F' GROUP BY 1 ORDER BY n DESC, target LIMIT 12")
def graph_top_relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_relations(b.dependencies(spark, sf), "F")


@query(
    f"""WITH {b.FILES}, {b.SYMBOLS}, {b.DEPENDENCIES}, {b.CALLS} SELECT (SELECT count(*) FROM files) AS files, (SELECT CAST(sum(line_count) AS BIGINT) FROM files) AS lines,
 (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM deps) AS dependencies, (SELECT count(*) FROM calls) AS calls"""
)
def overview_totals(spark: SparkSession, sf: str) -> DataFrame:
    return overview.totals(b.files(spark, sf), b.symbols(spark, sf), b.dependencies(spark, sf), b.calls(spark, sf))


@query(f"WITH {b.FILES} SELECT language, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines FROM files GROUP BY 1")
def overview_languages(spark: SparkSession, sf: str) -> DataFrame:
    return overview.languages(b.files(spark, sf))


@query(f"WITH {b.FILES} SELECT split_part(path, '/', 1) AS directory, count(*) AS files FROM files GROUP BY 1 ORDER BY files DESC, directory LIMIT 12")
def overview_directories(spark: SparkSession, sf: str) -> DataFrame:
    return overview.top_directories(b.files(spark, sf))


@query(
    f"""WITH {b.FILES}, {b.SYMBOLS}, per AS (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1) SELECT split_part(path, '/', 1) AS directory, count(*) AS files,
 CAST(sum(line_count) AS BIGINT) AS lines, CAST(coalesce(sum(n), 0) AS BIGINT) AS symbols, 'source' AS role
 FROM files LEFT JOIN per ON id = file_id GROUP BY 1 ORDER BY files DESC, directory LIMIT 12"""
)
def overview_main_directories(spark: SparkSession, sf: str) -> DataFrame:
    return overview.main_directories(b.files(spark, sf), b.symbols(spark, sf))


@query(f"WITH {b.SYMBOLS} SELECT kind, count(*) AS n FROM symbols GROUP BY 1")
def overview_symbol_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return overview.symbol_kinds(b.symbols(spark, sf))


@query(f"WITH {b.CALLS} SELECT count(*) AS edges, count(callee_file) AS resolved, count(*) - count(callee_file) AS unresolved FROM calls")
def overview_calls(spark: SparkSession, sf: str) -> DataFrame:
    return overview.call_summary(b.calls(spark, sf))


_ENTRY_NAMES = ("main.rs", "index.ts", "lib.rs", "app.py", "server.go", "cli.py", "urls.py", "util.rs", "program.cs", "mod.rs")


def _entry_files(spark: SparkSession, sf: str) -> DataFrame:
    d = b.table(spark, sf, "documents")
    names = F.element_at(F.array(*[F.lit(x) for x in _ENTRY_NAMES]), (F.col("doc_id") % 10 + 1).cast("int"))
    top = F.when(F.col("doc_id") % 7 == 0, "tests/").when(F.col("doc_id") % 5 == 0, "scripts/").otherwise("")
    return d.select(F.col("doc_id").alias("id"), F.concat(top, "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), names).alias("path"), F.col("lang").alias("language"))


def _entry_symbols(spark: SparkSession, sf: str) -> DataFrame:
    p = b.table(spark, sf, "part")
    name = F.element_at(F.array(*[F.lit(x) for x in ("main", "run", "helper", "handler", "parse")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select((F.col("p_partkey") % 200).alias("file_id"), name.alias("name"), F.concat("p_brand", F.lit("."), name).alias("qualified_name"))


@query(
    """WITH f AS (SELECT doc_id AS id, lang AS language, (CASE WHEN doc_id % 7 = 0 THEN 'tests/' WHEN doc_id % 5 = 0 THEN 'scripts/' ELSE '' END) || source || '/' || doc_id || '/' ||
  ['main.rs','index.ts','lib.rs','app.py','server.go','cli.py','urls.py','util.rs','program.cs','mod.rs'][doc_id % 10 + 1] AS path, doc_id % 10 AS k FROM documents),
 s AS (SELECT p_partkey % 200 AS file_id, ['main','run','helper','handler','parse'][p_partkey % 5 + 1] AS name, p_brand FROM part),
 sig AS (SELECT path, language, [100,80,90,75,70,65,79,NULL,79,85][k + 1] AS score,
   ['conventional main file','conventional index file','Rust library root','conventional app file','server entrypoint naming','CLI entrypoint naming','Python web framework entrypoint',NULL,'C# web application entrypoint','Rust module root'][k + 1] AS reason,
   NULL AS symbol, 0 AS turn FROM f
  UNION ALL SELECT path, language, CASE name WHEN 'main' THEN 110 WHEN 'run' THEN 88 WHEN 'handler' THEN 78 END,
   CASE name WHEN 'main' THEN 'entry symbol named main' WHEN 'run' THEN 'entry-like symbol named run' WHEN 'handler' THEN 'service entry-like symbol named handler' END, p_brand || '.' || name, 1
  FROM f JOIN s ON f.id = s.file_id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, turn, symbol NULLS FIRST) AS r, min(symbol) OVER (PARTITION BY path) AS hint FROM sig WHERE score IS NOT NULL),
 best AS (SELECT path, language, CASE WHEN starts_with(path, 'tests/') THEN 'test' ELSE 'source' END AS role, CAST(score AS INTEGER) AS score, round(least(score, 110) / 110.0, 2) AS confidence, reason, coalesce(symbol, hint) AS symbol FROM ranked WHERE r = 1)
 SELECT path, language, role, score, CAST(confidence AS DOUBLE) AS confidence, reason, symbol FROM best
 ORDER BY score + CASE WHEN starts_with(path, 'scripts/') THEN -40 WHEN role = 'test' THEN -60 ELSE 0 END DESC, path LIMIT 12"""
)
def entrypoints(spark: SparkSession, sf: str) -> DataFrame:
    return overview.entrypoints(_entry_files(spark, sf), _entry_symbols(spark, sf))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'vendor' WHEN doc_id % 6 = 1 THEN 'fixture' WHEN doc_id % 6 = 2 THEN 'test' WHEN doc_id % 6 = 3 THEN 'example' WHEN doc_id % 6 = 4 THEN 'docs' ELSE 'source' END AS role FROM documents")
def path_roles(spark: SparkSession, sf: str) -> DataFrame:
    tops = F.array(*[F.lit(x) for x in ("Node_Modules/", "tests/Fixtures/", "tests/", "Examples/", "docs/", "src/")])
    path = F.concat(F.element_at(tops, (F.col("doc_id") % 6 + 1).cast("int")), F.col("source"))
    return b.table(spark, sf, "documents").select("doc_id", path_role(path).alias("role"))


@query(
    f"""WITH {b.SYMBOLS} SELECT id, name, qualified_name, kind, CASE WHEN name = 'r_d' OR qualified_name = 'r_d' THEN 0 WHEN name ILIKE 'r_d%' THEN 1 ELSE 2 END AS match_rank
 FROM symbols WHERE name ILIKE '%r_d%' OR qualified_name ILIKE '%r_d%' ORDER BY match_rank, length(qualified_name), qualified_name, id LIMIT 5000"""
)
def symbol_search(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.symbol_search(b.symbols(spark, sf), "r_d", 5000).select("id", "name", "qualified_name", "kind", "match_rank")


@query(
    f"""WITH {b.SYMBOLS}, seeds AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 150)) t(seed_pos, f)) SELECT CAST(seed_pos AS INTEGER) AS seed_pos, id, file_id, name, start_line, end_line
 FROM symbols JOIN seeds ON file_id = f ORDER BY seed_pos, start_line, end_line, id LIMIT 25"""
)
def symbols_for_files(spark: SparkSession, sf: str) -> DataFrame:
    seeds = lookup.numbered(spark, ["7", "3", "150"], "seed").withColumn("seed", F.col("seed").cast("long"))
    return lookup.for_seeds(b.symbols(spark, sf), seeds, "file_id", ["start_line", "end_line", "id"], 25).select("seed_pos", "id", "file_id", "name", "start_line", "end_line")


@query(f"WITH {b.SYMBOLS} SELECT id, name, start_line, end_line FROM symbols WHERE file_id = 5 AND ((start_line <= 12 AND end_line >= 8) OR (start_line <= 45 AND end_line >= 40))")
def outline_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.outline(b.symbols(spark, sf).filter("file_id = 5"), [(8, 12), (40, 45)]).select("id", "name", "start_line", "end_line")


_SEEDS = "seeds AS (SELECT * FROM (VALUES (0, 'order/1'), (1, 'Supplier#000000003'), (2, 'order/7')) t(seed_pos, seed))"
_SEED_LIST = ["order/1", "Supplier#000000003", "order/7"]


@query(
    f"""WITH {b.DEPENDENCIES}, {_SEEDS} SELECT source_file, target, resolved_file, kind, language, line, CAST(seed_pos AS INTEGER) AS seed_pos
 FROM deps JOIN seeds ON source_file = seed OR resolved_file = seed"""
)
def edges_touching(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.edges_touching(b.dependencies(spark, sf), lookup.numbered(spark, _SEED_LIST, "seed"))


@query(
    f"""WITH {b.DEPENDENCIES}, {_SEEDS} SELECT source_file, target, resolved_file, kind, language, line, CAST(seed_pos AS INTEGER) AS seed_pos
 FROM deps JOIN seeds ON resolved_file = seed"""
)
def importers_of(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.importers_of(b.dependencies(spark, sf), lookup.numbered(spark, _SEED_LIST, "seed"))


@query(
    f"""WITH {b.DEPENDENCIES}, {_SEEDS} SELECT source_file, target, resolved_file, kind, language, line, CAST(seed_pos AS INTEGER) AS seed_pos
 FROM deps JOIN seeds ON source_file = seed WHERE resolved_file IS NOT NULL"""
)
def resolved_edges(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.resolved_edges(b.dependencies(spark, sf), lookup.numbered(spark, _SEED_LIST, "seed"))


@query(
    f"""WITH {b.DEPENDENCIES}, named AS (SELECT *, 'ns.' || target AS dotted FROM deps WHERE kind = 'F'), picked AS (SELECT min(target) AS t FROM deps)
 SELECT DISTINCT source_file, dotted AS target, line FROM named, picked WHERE dotted = t OR ends_with(lower(dotted), '.' || lower(t)) ORDER BY source_file, line, target LIMIT 50"""
)
def relation_importers(spark: SparkSession, sf: str) -> DataFrame:
    deps = b.dependencies(spark, sf)
    symbol = b.table(spark, sf, "part").agg(F.min("p_name")).first()[0]
    return lookup.relation_importers(deps.withColumn("target", F.concat(F.lit("ns."), "target")), [symbol], "F", 50).select("source_file", "target", "line")


@query(f"WITH {b.CALLS} SELECT id, caller, callee, file, line FROM calls WHERE callee = 'click' OR ends_with(lower(callee), '.click') ORDER BY file, line, id LIMIT 50")
def callers(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.callers(b.calls(spark, sf), "click").select("id", "caller", "callee", "file", "line")


@query(f"WITH {b.CALLS} SELECT id, caller, callee, file, line FROM calls WHERE caller = 'user.7' OR ends_with(lower(caller), '.user.7') ORDER BY file, line, id LIMIT 50")
def callees(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.callees(b.calls(spark, sf), "user.7").select("id", "caller", "callee", "file", "line")


def _reference_sql(symbol: str) -> str:
    """DuckDB text of reference lines of a symbol that needs no escapes."""
    edge, rest = "(^|[^a-zA-Z0-9_])", "([^a-zA-Z0-9_]|$)"
    has = lambda p: f"regexp_matches(text, '{p}')"
    return f"""l AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM (SELECT source || '/doc_' || doc_id AS path, string_split(text, chr(10)) AS ls FROM documents)),
 k AS (SELECT path, CAST(line AS BIGINT) AS line, CAST(length(regexp_extract(text, '^(.*?{edge}){symbol}{rest}', 1)) + 1 AS BIGINT) AS "column",
  CASE WHEN {has('^[ 	]*(import|from|use|using|require|include|#include)' + rest)} THEN 'import'
   WHEN {has(edge + '(def|fn|func|function|class|struct|interface|trait|enum|type)[ 	]+' + symbol + rest)} THEN 'definition'
   WHEN {has(edge + '(extends|implements)' + rest + '.*' + symbol + rest)} THEN 'inheritance'
   WHEN {has(edge + symbol + '[ 	]*[(]')} THEN 'call' WHEN {has(edge + symbol + '[ 	]*=[^=]')} THEN 'assignment' ELSE 'read' END AS kind, text
  FROM l WHERE {has(edge + symbol + rest)} AND NOT {has('^[ 	]*(//|#|--|[*]|/[*])')}),
 r AS (SELECT path, line, "column", kind, CAST(round(CASE kind WHEN 'definition' THEN 0.95 WHEN 'import' THEN 0.9 WHEN 'call' THEN 0.85 WHEN 'inheritance' THEN 0.85 WHEN 'assignment' THEN 0.7 ELSE 0.5 END
  - CASE WHEN regexp_matches(lower(path), '(^|/)tests?/|_tests?[.]|[.](test|spec)[.]') THEN 0.2 ELSE 0 END, 2) AS DOUBLE) AS confidence, text FROM k)"""


@query(f"WITH {_reference_sql('the')} SELECT path, line, kind, text FROM r")
def references_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = b.table(spark, sf, "documents")
    texts = d.select(F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string")).alias("path"), "text")
    return lookup.reference_lines(texts, "the").select("path", "line", "kind", "text")


@query(f"WITH {_reference_sql('the')} SELECT path, line, \"column\", kind, confidence, text FROM r WHERE kind <> 'definition' ORDER BY confidence DESC, path, line LIMIT 100")
def references_ranked(spark: SparkSession, sf: str) -> DataFrame:
    d = b.table(spark, sf, "documents")
    return lookup.find_references(d.select(F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string")).alias("path"), "text"), "the")


@query(
    f"""WITH {b.SYMBOLS}, keys AS (SELECT DISTINCT 'part ' || p_size AS k FROM part UNION SELECT DISTINCT p_name FROM part)
 SELECT k AS key, id, qualified_name FROM symbols JOIN keys ON qualified_name = k OR ends_with(lower(qualified_name), '.' || lower(k))"""
)
def suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    p = b.table(spark, sf, "part")
    keys = p.select(F.concat(F.lit("part "), F.col("p_size").cast("string")).alias("key")).union(p.select("p_name")).distinct()
    return resolve.suffix_join(keys, "key", b.symbols(spark, sf), "qualified_name").select("key", "id", "qualified_name")


@query(
    f"""WITH {b.CALLS}, aliases AS (SELECT DISTINCT 'user' AS alias UNION SELECT 'USER' UNION SELECT 'svc') SELECT alias, id, caller FROM calls JOIN aliases
 ON starts_with(lower(caller), lower(alias) || '.')"""
)
def prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    aliases = spark.createDataFrame([("user",), ("USER",), ("svc",)], "alias string")
    return resolve.prefix_join(b.calls(spark, sf), "caller", aliases, "alias").select("alias", "id", "caller")


@query(
    f"""WITH {b.FILES}, ends AS (SELECT DISTINCT 'en/doc_' || (doc_id % 50) AS suffix FROM documents UNION SELECT DISTINCT 'oc_' || (doc_id % 30) FROM documents)
 SELECT suffix, id, path FROM files JOIN ends ON ends_with(lower(path), lower(suffix))"""
)
def path_suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    d = b.table(spark, sf, "documents")
    ends = d.select(F.concat(F.lit("en/doc_"), (F.col("doc_id") % 50).cast("string")).alias("suffix")).union(d.select(F.concat(F.lit("oc_"), (F.col("doc_id") % 30).cast("string")))).distinct()
    return resolve.path_suffix_join(ends, "suffix", b.files(spark, sf)).select("suffix", "id", "path")


# Call resolution: calls of events, imports from lineitem by day, symbols from part.
_RESOLVE_BASE = """c AS (SELECT event_id AS call_id, CAST(user_id % 50 AS BIGINT) AS src, ['view','signup','purchase','error','click'][event_id % 5 + 1] AS callee FROM events WHERE event_id % 3 <> 0),
 d AS (SELECT DISTINCT CAST(l_orderkey % 50 AS BIGINT) AS src, CAST(l_partkey % 20 AS BIGINT) AS target, CAST(l_linenumber AS BIGINT) AS line FROM lineitem),
 s AS (SELECT p_partkey AS sid, p_partkey % 20 AS file_id, ['view','signup','purchase','error','click','other','misc'][p_partkey % 7 + 1] AS name, p_brand || '.' || ['view','signup','purchase','error','click','other','misc'][p_partkey % 7 + 1] AS qualified_name,
   CAST(p_size AS BIGINT) AS start_line FROM part),
 k AS (SELECT DISTINCT src, callee FROM c),
 cand AS (SELECT k.src, callee, 'file/' || target AS callee_file, qualified_name, line AS dependency_line, start_line, 1 AS match_rank FROM k JOIN d ON k.src = d.src JOIN s ON d.target = s.file_id AND s.name = k.callee)"""


def _resolve_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e, line, part = (b.table(spark, sf, t) for t in ("events", "lineitem", "part"))
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    kinds = ("view", "signup", "purchase", "error", "click")
    calls = e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("source_file_id"), pick(kinds, F.col("event_id") % 5).alias("callee"),
        F.when(F.col("event_id") % 3 == 0, "file/0").alias("callee_file"), F.lit("python").alias("language"), F.lit("f").alias("caller"), F.lit(0).cast("long").alias("line"), F.lit(0.55).alias("confidence"),
    )
    deps = line.select(
        (F.col("l_orderkey") % 50).alias("source_file_id"), F.concat(F.lit("file/"), (F.col("l_partkey") % 20).cast("string")).alias("resolved_file"), F.col("l_linenumber").cast("long").alias("line")
    ).distinct().select(
        "source_file_id", "resolved_file", F.lit(None).cast("string").alias("local_alias"), F.lit(None).cast("string").alias("imported_symbol"), F.lit("import").alias("kind"), F.lit("python").alias("language"), "line"
    )
    files = spark.range(20).select("id", F.concat(F.lit("file/"), F.col("id").cast("string")).alias("path"))
    name = pick((*kinds, "other", "misc"), F.col("p_partkey") % 7)
    symbols = part.select(
        (F.col("p_partkey") % 20).alias("file_id"), name.alias("name"), F.concat("p_brand", F.lit("."), name).alias("qualified_name"), F.lit("function").alias("kind"), F.col("p_size").cast("long").alias("start_line")
    )
    return calls, deps, files, symbols


@query(
    f"""WITH {_RESOLVE_BASE}, best AS (SELECT src, callee, callee_file FROM (SELECT *, row_number() OVER (PARTITION BY src, callee
 ORDER BY match_rank, length(qualified_name), dependency_line, start_line, callee_file) AS r FROM cand) WHERE r = 1) SELECT call_id, callee_file FROM c JOIN best USING (src, callee)"""
)
def resolve_calls_ranked(spark: SparkSession, sf: str) -> DataFrame:
    candidates, members = _direct(spark, sf)
    return resolve.of_members(resolve.best_candidates([candidates]), members).select("call_id", "callee_file")


def _direct(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    calls, deps, files, symbols = _resolve_inputs(spark, sf)
    reps, members = resolve.representatives(calls)
    return arms.direct_candidates(reps, deps, files, symbols), members


@query(
    f"""WITH {_RESOLVE_BASE}, several AS (SELECT src, callee, count(DISTINCT callee_file) AS n FROM cand GROUP BY 1, 2 HAVING count(DISTINCT callee_file) > 1)
 SELECT call_id, n FROM c JOIN several USING (src, callee)"""
)
def ambiguous_targets(spark: SparkSession, sf: str) -> DataFrame:
    candidates, members = _direct(spark, sf)
    return resolve.of_members(resolve.ambiguous_calls(candidates), members).select("call_id", "n")


@query(f"WITH {b.DEPENDENCIES} SELECT source_file, min(resolved_file) AS resolved_file FROM deps WHERE resolved_file IS NOT NULL GROUP BY 1 HAVING count(DISTINCT resolved_file) = 1")
def unique_target(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.unique_targets(b.dependencies(spark, sf).filter("resolved_file is not null"), "source_file", "resolved_file")


_HOP = """c AS (SELECT event_id AS call_id, user_id % 40 AS src, 'n' || (event_id % 9) AS callee FROM events),
 d AS (SELECT DISTINCT l_orderkey % 40 AS src, 'f' || (l_partkey % 15) AS target, 'n' || (l_partkey % 9) AS alias FROM lineitem),
 r AS (SELECT p_partkey % 15 AS id, 'f' || (p_partkey * 7 % 15) AS target, 'n' || (p_partkey % 9) AS alias, 'n' || (p_partkey * 4 % 9) AS imported, CAST(p_size AS BIGINT) AS line FROM part),
 s AS (SELECT s_suppkey % 15 AS file_id, 'n' || (s_suppkey % 9) AS name, 'q.n' || (s_suppkey % 9) AS qualified_name, CAST(s_suppkey AS BIGINT) AS start_line FROM supplier),
 k AS (SELECT DISTINCT src, callee FROM c),
 h0 AS (SELECT DISTINCT k.src, callee, target AS place, callee AS wanted FROM k JOIN d ON k.src = d.src),
 h1 AS (SELECT DISTINCT src, callee, r.target AS place, r.imported AS wanted FROM h0 JOIN r ON h0.place = 'f' || r.id AND h0.wanted = r.alias),
 h2 AS (SELECT DISTINCT src, callee, r.target AS place, r.imported AS wanted FROM h1 JOIN r ON h1.place = 'f' || r.id AND h1.wanted = r.alias)"""


def _hop_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e, line, part, sup = (b.table(spark, sf, t) for t in ("events", "lineitem", "part", "supplier"))
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    null = F.lit(None).cast("string")
    calls = e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("source_file_id"), text("n", F.col("event_id") % 9).alias("callee"), null.alias("callee_file"),
        F.lit("typescript").alias("language"), F.lit("f").alias("caller"), F.lit(1).cast("long").alias("line"),
    )
    imports = line.select(
        (F.col("l_orderkey") % 40 + 100).alias("source_file_id"), text("f", F.col("l_partkey") % 15).alias("resolved_file"), text("n", F.col("l_partkey") % 9).alias("local_alias"),
        null.alias("imported_symbol"), F.lit("import").alias("kind"), F.lit(1).cast("long").alias("line"),
    ).distinct()
    calls = calls.withColumn("source_file_id", F.col("source_file_id") + 100)
    again = part.select(
        (F.col("p_partkey") % 15).alias("source_file_id"), text("f", F.col("p_partkey") * 7 % 15).alias("resolved_file"), text("n", F.col("p_partkey") % 9).alias("local_alias"),
        text("n", F.col("p_partkey") * 4 % 9).alias("imported_symbol"), F.lit("export_alias").alias("kind"), F.col("p_size").cast("long").alias("line"),
    )
    files = spark.range(15).select("id", text("f", F.col("id")).alias("path"))
    symbols = sup.select((F.col("s_suppkey") % 15).alias("file_id"), text("n", F.col("s_suppkey") % 9).alias("name"), text("q.n", F.col("s_suppkey") % 9).alias("qualified_name"), F.col("s_suppkey").alias("start_line"))
    return calls, imports.unionByName(again), files, symbols


def _hop_sql(state: str, rank: int) -> str:
    return f"""WITH {_HOP}, cand AS (SELECT src, callee, place AS callee_file, qualified_name, start_line FROM {state} JOIN s ON place = 'f' || file_id AND name = wanted),
 best AS (SELECT src, callee, callee_file FROM (SELECT *, row_number() OVER (PARTITION BY src, callee ORDER BY length(qualified_name), start_line, callee_file) AS r FROM cand) WHERE r = 1)
 SELECT call_id, callee_file, CAST({rank} AS INTEGER) AS match_rank FROM c JOIN best USING (src, callee)"""


def _hops(spark: SparkSession, sf: str, rank: int) -> DataFrame:
    """Calls resolved by the routes of re-exports that have ``rank``."""
    calls, deps, files, symbols = _hop_inputs(spark, sf)
    deps = deps.withColumn("language", F.lit("typescript"))
    reps, members = resolve.representatives(calls)
    one, _, two, *_ = arms.reexport_routes(reps, deps, files)
    found = arms.find_members((one if rank == -1 else two)[0], files, symbols)
    return resolve.of_members(resolve.best_candidates([found]), members)


@query(_hop_sql("h1", -1))
def reexport_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    return _hops(spark, sf, -1)


@query(_hop_sql("h2", -2))
def reexport_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    return _hops(spark, sf, -2)


@query(
    """WITH g AS (SELECT DISTINCT 'order/' || l_orderkey AS file, CAST(l_suppkey AS VARCHAR) AS target FROM lineitem),
 n AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS target, 'name' || (l_partkey % 97) AS name FROM lineitem)
 SELECT g.file, n.name, min(g.target) AS target FROM g JOIN n ON g.target = n.target GROUP BY 1, 2 HAVING count(DISTINCT g.target) = 1"""
)
def glob_conflict_anti(spark: SparkSession, sf: str) -> DataFrame:
    line = b.table(spark, sf, "lineitem")
    globs = line.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("file"), F.col("l_suppkey").cast("string").alias("target")).distinct()
    names = line.select(F.col("l_suppkey").cast("string").alias("target"), F.concat(F.lit("name"), (F.col("l_partkey") % 97).cast("string")).alias("name")).distinct()
    return resolve.unambiguous_globs(globs, names)


@query(
    f"""WITH RECURSIVE {b.WALK_EDGES}, starts AS (SELECT n_name AS start FROM nation WHERE n_nationkey < 3),
 reach AS (SELECT start, start AS node FROM starts UNION SELECT r.start, e.dst FROM reach r JOIN edges e ON r.node = e.src) SELECT start, node FROM reach"""
)
def include_closure(spark: SparkSession, sf: str) -> DataFrame:
    starts = b.table(spark, sf, "nation").filter("n_nationkey < 3").select(F.col("n_name").alias("start"))
    return resolve.closure(b.walk_edges(spark, sf), starts)


@query(
    f"""WITH RECURSIVE {b.WALK_EDGES}, reach AS (SELECT n_name AS start, n_name AS node, 0 AS depth FROM nation WHERE n_nationkey < 2
 UNION SELECT r.start, e.dst, r.depth + 1 FROM reach r JOIN edges e ON r.node = e.src WHERE r.depth < 3) SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM reach WHERE depth > 0 GROUP BY 1, 2"""
)
def walk_depth(spark: SparkSession, sf: str) -> DataFrame:
    starts = b.table(spark, sf, "nation").filter("n_nationkey < 2").select(F.col("n_name").alias("start"))
    return resolve.walk(b.walk_edges(spark, sf), starts, 3)


@query(
    f"""WITH {b.SYMBOLS}, c AS (SELECT event_id, CAST(user_id % 200 AS BIGINT) AS file_id, CAST(minute(ts) AS BIGINT) AS line FROM events),
 m AS (SELECT event_id, qualified_name, row_number() OVER (PARTITION BY event_id ORDER BY start_line DESC, s.id DESC) AS r FROM c JOIN symbols s ON c.file_id = s.file_id AND start_line <= line AND line <= end_line)
 SELECT c.event_id, c.line, coalesce(qualified_name, '<module>') AS caller FROM c LEFT JOIN m ON c.event_id = m.event_id AND r = 1"""
)
def caller_of_line(spark: SparkSession, sf: str) -> DataFrame:
    """The innermost symbol around the line of each event, found once for each file and line."""
    c = b.table(spark, sf, "events").select("event_id", (F.col("user_id") % 200).alias("file_id"), F.minute("ts").cast("long").alias("line"))
    return c.join(lookup.enclosing(c, b.symbols(spark, sf)), ["file_id", "line"]).select("event_id", "line", "caller")
