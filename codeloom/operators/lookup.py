"""Lookups: symbols, edges, calls, outlines, terms and text references.

Several seeds are answered by one job: seeds are numbered, joined, and the rows
ordered by seed, so that one limit does what a query for each seed would.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.names import ascii_lower

MAX_RANGES = 16
MAX_TERMS = 16
#: Seeds of one request; they are broadcast.
MAX_SEEDS = 10_000
#: Lines of a bucket in which points and the symbols around them meet.
BUCKET_LINES = 64
ESCAPE = "\u0001"


def numbered(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """(seed_pos, name) of seeds in order; a list of the caller, of at most MAX_SEEDS."""
    if len(values) > MAX_SEEDS:
        raise ValueError(f"{len(values)} seeds; at most {MAX_SEEDS}")
    return spark.createDataFrame(list(enumerate(values)), f"seed_pos int, {name} string")


def symbol_search(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Infix match on name or qualified name: exact first, then prefix, then the rest, short names first.

    ``_`` and ``%`` in the query are wildcards, letters match in either case.
    """
    # The pattern's own ESCAPE character keeps a backslash in the query from being one.
    like = lambda c, p: F.expr(f"ilike({c}, {_literal(p)}, '{ESCAPE}')")
    found = symbols.filter(like("name", f"%{query}%") | like("qualified_name", f"%{query}%"))
    rank = F.when((F.col("name") == query) | (F.col("qualified_name") == query), 0).when(like("name", f"{query}%"), 1).otherwise(2)
    return found.withColumn("match_rank", rank).orderBy("match_rank", F.length("qualified_name"), "qualified_name", "id").limit(limit)


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def for_seeds(rows: DataFrame, seeds: DataFrame, key: str, order: list[str | Column], limit: int | None) -> DataFrame:
    """Rows whose ``key`` is a seed, in seed order; rows of repeated seeds repeat."""
    seed = [c for c in seeds.columns if c != "seed_pos"][0]
    # ``numbered`` bounds the seeds.
    found = rows.join(F.broadcast(seeds), rows[key] == seeds[seed]).drop(seed)
    return found.orderBy("seed_pos", *order).limit(limit) if limit is not None else found


def edges_touching(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges whose source or resolved file is a seed; one row for each seed and edge."""
    seed = [c for c in seeds.columns if c != "seed_pos"][0]
    s = F.broadcast(seeds)
    by_source = edges.join(s, edges["source_file"] == seeds[seed]).drop(seed)
    # The second join leaves out what the first has found.
    by_target = edges.join(s, (edges["resolved_file"] == seeds[seed]) & ~edges["source_file"].eqNullSafe(seeds[seed])).drop(seed)
    found = by_source.unionByName(by_target)
    return found.orderBy("seed_pos", "source_file", "line", "target").limit(limit) if limit is not None else found


def importers_of(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    return for_seeds(edges, seeds, "resolved_file", ["source_file", "line", "target"], limit)


def resolved_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return for_seeds(edges.filter("resolved_file is not null"), seeds, "source_file", [], None)


def relation_importers(edges: DataFrame, symbols: list[str], relation_kind: str = "base_type", limit: int = 50) -> DataFrame:
    """Type relations whose target is a symbol or ends with '.symbol', repeats removed before the limit."""
    target = ascii_lower(F.col("target"))
    fits = F.lit(False)
    for s in symbols:
        fits = fits | (F.col("target") == s) | target.endswith("." + s.lower())
    found = edges.filter((F.col("kind") == relation_kind) & fits)
    return found.dropDuplicates(["source_file", "target", "line"]).orderBy("source_file", "line", "target").limit(limit)


def _calls_named(calls: DataFrame, column: str, symbol: str, limit: int | None) -> DataFrame:
    """Equal, or ends with '.symbol' (letters in either case)."""
    fits = (F.col(column) == symbol) | ascii_lower(F.col(column)).endswith("." + symbol.lower())
    found = calls.filter(fits)
    return found.orderBy("file", "line", "id").limit(limit) if limit is not None else found


def callers(calls: DataFrame, symbol: str, limit: int | None = 50) -> DataFrame:
    return _calls_named(calls, "callee", symbol, limit)


def callees(calls: DataFrame, symbol: str, limit: int | None = 50) -> DataFrame:
    return _calls_named(calls, "caller", symbol, limit)


def outline(symbols: DataFrame, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """Symbols, or those that overlap one of at most 16 line ranges."""
    if not ranges:
        return symbols
    if len(ranges) > MAX_RANGES:
        raise ValueError(f"at most {MAX_RANGES} ranges")
    overlaps = F.lit(False)
    for start, end in ranges:
        overlaps = overlaps | ((F.col("start_line") <= end) & (F.col("end_line") >= start))
    return symbols.filter(overlaps)


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, line, caller): the innermost symbol around each distinct (file_id, line) of ``points``, else '<module>'.

    Lines and symbols meet by file and bucket of lines, so that a line is compared with
    the symbols near it and not with all of its file; of several the last to begin wins.
    """
    at = points.select("file_id", "line").distinct().withColumn("_bucket", F.floor(F.col("line") / BUCKET_LINES))
    bucket = lambda c: F.floor(F.col(c) / BUCKET_LINES)
    s = symbols.filter("end_line >= start_line").select(F.col("file_id").alias("_file"), "id", "qualified_name", "start_line", "end_line", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))).alias("_of"))
    inside = at.join(s, (F.col("file_id") == F.col("_file")) & (F.col("_bucket") == F.col("_of")) & (F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line")), "left")
    best = inside.groupBy("file_id", "line").agg(F.max_by("qualified_name", F.struct("start_line", "id")).alias("_q"))
    return best.select("file_id", "line", F.coalesce("_q", F.lit("<module>")).alias("caller"))


def search_terms(terms: list[str]) -> list[str]:
    """Lower-cased, trimmed, at least 3 bytes, sorted, unique, the first 16."""
    clean = {re.sub("[A-Z]", lambda m: m[0].lower(), t).strip() for t in terms}
    return sorted(t for t in clean if len(t.encode()) >= 3)[:MAX_TERMS]


def chunks_matching(chunks: DataFrame, terms: list[str], limit: int | None = None) -> DataFrame:
    """Chunks whose text contains any term, in order of (file, start_line)."""
    wanted, text, fits = search_terms(terms), ascii_lower(F.col("text")), F.lit(False)
    for t in wanted:
        fits = fits | (F.instr(text, t) > 0)
    found = chunks.filter(fits)
    return found.orderBy("file", "start_line").limit(limit) if limit is not None else found


def reference_lines(texts: DataFrame, symbol: str) -> DataFrame:
    """(path, line, column, kind, confidence, text): lines that name ``symbol`` as a whole word.

    Lines that are only a comment are left out. The kind is inferred from what stands
    around the first occurrence; the confidence goes with the kind and is lower in tests.
    """
    word = re.escape(symbol)
    lines = texts.filter(F.contains("text", F.lit(symbol))).select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    at = F.regexp_instr("text", F.lit(rf"\b{word}\b"))
    hit = lines.withColumn("column", at).filter((at > 0) & ~F.col("text").rlike(r"^\s*(//|#|--|\*|/\*)"))
    kind = (
        F.when(F.col("text").rlike(rf"^\s*(import|from|use|using|require|include|#include)\b"), "import")
        .when(F.col("text").rlike(rf"\b(def|fn|func|function|class|struct|interface|trait|enum|type)\s+{word}\b"), "definition")
        .when(F.col("text").rlike(rf"\b(extends|implements)\b.*\b{word}\b"), "inheritance")
        .when(F.col("text").rlike(rf"\b{word}\s*\("), "call")
        .when(F.col("text").rlike(rf"\b{word}\s*=[^=]"), "assignment")
        .otherwise("read")
    )
    base = F.expr("element_at(map('definition', 0.95D, 'import', 0.9D, 'call', 0.85D, 'inheritance', 0.85D, 'assignment', 0.7D, 'read', 0.5D), kind)")
    in_test = F.col("path").rlike(r"(?i)(^|/)tests?/|_tests?\.|\.(test|spec)\.")
    return (
        hit.withColumn("kind", kind)
        .withColumn("confidence", F.round(base - F.when(in_test, 0.2).otherwise(0.0), 2))
        .select("path", (F.col("pos") + 1).cast("long").alias("line"), F.col("column").cast("long").alias("column"), "kind", "confidence", "text")
    )


def find_references(texts: DataFrame, symbol: str, limit: int = 100, include_definitions: bool = False) -> DataFrame:
    found = reference_lines(texts, symbol)
    if not include_definitions:
        found = found.filter("kind <> 'definition'")
    return found.orderBy(F.desc("confidence"), "path", "line").limit(limit)
