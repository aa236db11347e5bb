"""Extraction, path resolution and call resolution over files that are generated from a driver table.

Every supplier gets its own copy of each file, with its key in the names, and goes through
the library's own operators; the DuckDB text puts the key into what was written down by
hand, so each row of the table is a round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.names import line_count
from codeloom.operators import arms, index
from codeloom.operators.scratch import materialize_bounded
from codeloom.parse import paths
from codeloom.plans import bindings as b
from codeloom.plans.call_cases import CASES, Case
from codeloom.plans.path_cases import FILES, METADATA, TARGETS
from codeloom.plans.registry import query
from codeloom.plans.source_texts import FOUND, TEXTS

_KEY = "CAST(s_suppkey AS VARCHAR)"


def _quoted(value: object) -> str:
    if value is None or value == "-":
        return "NULL"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _expected(rows: list[tuple], names: list[str], kinds: list[str]) -> str:
    """DuckDB text of ``rows`` for every supplier, with its key in each text."""
    values = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)
    picked = ", ".join(f"replace(CAST(v.{n} AS VARCHAR), '{{k}}', {_KEY}) AS {n}" if k == "string" else f"CAST(v.{n} AS {k}) AS {n}" for n, k in zip(names, kinds))
    return f"SELECT {picked} FROM supplier, (VALUES {values}) v({', '.join(names)})"


def _generated(spark: SparkSession, sf: str, rows: list[tuple], names: list[str], spread: bool = False) -> DataFrame:
    """``rows`` of texts for every supplier, its key put into each; ``spread`` deals the keys to all cores, however few files they come from."""
    key = F.col("s_suppkey").cast("string")
    lit = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else F.lit(v).cast("double" if isinstance(v, float) else "long")
    structs = F.array(*[F.struct(*[lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    keys = b.table(spark, sf, "supplier").select(key.alias("_key"))
    keys = keys.repartition(4 * spark.sparkContext.defaultParallelism, "_key") if spread else keys
    exploded = keys.select("_key", F.explode(structs).alias("r"))
    filled = lambda n: F.replace(F.col(f"r.{n}"), F.lit("{k}"), F.col("_key"))
    texts = {n for n, v in zip(names, rows[0]) if v is None or isinstance(v, str)}
    return exploded.select(*[(filled(n) if n in texts else F.col(f"r.{n}")).alias(n) for n in names])


# --- extraction ------------------------------------------------------------------------

_FOUND = ["path", "part", "name", "kind", "alias", "imported", "line", "end_line", "own"]


def _found_rows(language: str) -> list[tuple]:
    rows = [line.split("|") for line in FOUND[language].strip().splitlines()]
    return [(TEXTS[language][0], *r[:5], int(r[5]), None if r[6] == "-" else int(r[6]), None if r[7] == "-" else r[7]) for r in rows]


def _extracted(spark: SparkSession, sf: str, language: str) -> DataFrame:
    path, text = TEXTS[language]
    files = _generated(spark, sf, [(path, language, text)], ["path", "language", "text"])
    found = index.extract_files(files)
    null = F.lit(None)
    symbols = found.select("path", F.explode("symbols").alias("s")).select(
        "path", F.lit("symbol").alias("part"), F.col("s.qualified_name").alias("name"), F.col("s.kind").alias("kind"), null.cast("string").alias("alias"), null.cast("string").alias("imported"),
        F.col("s.start_line").alias("line"), F.col("s.end_line").alias("end_line"), null.cast("string").alias("own"),
    )
    edges = found.select("path", F.explode("dependencies").alias("d")).select(
        "path", F.lit("edge").alias("part"), F.col("d.target").alias("name"), F.col("d.kind").alias("kind"), F.col("d.local_alias").alias("alias"), F.col("d.imported_symbol").alias("imported"),
        F.col("d.line").alias("line"), null.cast("long").alias("end_line"), null.cast("string").alias("own"),
    )
    calls = found.select("path", F.explode("calls").alias("c")).select(
        "path", F.lit("call").alias("part"), F.col("c.callee").alias("name"), F.col("c.caller").alias("kind"), null.cast("string").alias("alias"), null.cast("string").alias("imported"),
        F.col("c.line").alias("line"), null.cast("long").alias("end_line"), F.when(F.col("c.own"), "own").otherwise("open").alias("own"),
    )
    return symbols.unionByName(edges).unionByName(calls)


def _register_extraction(language: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _extracted(spark, sf, language)

    run.__name__ = f"extract_{language}"
    run.__doc__ = f"Symbols, edges and calls of a {language} file for every supplier."
    query(_expected(_found_rows(language), _FOUND, ["string"] * 6 + ["BIGINT", "BIGINT", "string"]))(run)


for _language in TEXTS:
    _register_extraction(_language)


# --- the whole index -------------------------------------------------------------------


def generated_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a source tree as its scan gives them: a file of every language for every supplier."""
    files = _generated(spark, sf, [(path, language, text) for language, (path, text) in TEXTS.items()], ["path", "language", "text"], spread=True)
    text = F.col("text")
    return files.withColumn("error", F.lit(None).cast("string")).withColumn("size", F.octet_length(text).cast("long")).withColumn("modified", F.lit(0).cast("long")).withColumn(
        "hash", F.sha2(text, 256)
    ).withColumn("line_count", line_count(text))


def _part_count(part: str) -> int:
    return sum(r.startswith(part + "|") for rows in FOUND.values() for r in rows.strip().splitlines())


@query(
    f"""SELECT {len(TEXTS)} * count(*) AS files, CAST({sum(t.count(chr(10)) for _, t in TEXTS.values())} * count(*) AS BIGINT) AS "lines", {_part_count("symbol")} * count(*) AS symbols,
 {_part_count("edge")} * count(*) AS dependencies, {_part_count("call")} * count(*) AS calls, 0 * count(*) AS errors FROM supplier"""
)
def index_report(spark: SparkSession, sf: str) -> DataFrame:
    """Files of all languages extracted, resolved and counted: the whole build of an index."""
    return index.build_index(generated_tree(spark, sf)).report()


# --- path resolution ---------------------------------------------------------------------

_TARGET = ["language", "source_file", "target", "kind"]


def _register_paths(family: str) -> None:
    rows = TARGETS[family]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        deps = _generated(spark, sf, [r[:4] for r in rows], _TARGET)
        known = _generated(spark, sf, [(f,) for f in FILES[family]], ["path"]).distinct()
        return index.resolve_paths(deps, known, paths.context_from(METADATA.get(family, {}))).select(*_TARGET, "resolved_file")

    run.__name__ = f"paths_{family}"
    run.__doc__ = f"Files that {family} targets lead to, for every supplier."
    query(_expected(rows, [*_TARGET, "resolved_file"], ["string"] * 5))(run)


for _family in TARGETS:
    _register_paths(_family)


# --- call resolution ---------------------------------------------------------------------


def _id(path: Column) -> Column:
    return F.xxhash64(path)


def _resolved(spark: SparkSession, sf: str, cases: list[Case]) -> DataFrame:
    """Targets of the open calls of all ``cases``; each case has its own folder, and so has every supplier."""
    at = lambda c, p: p if p is None else f"{c.name}/s{{k}}/{p}"
    named = lambda c, t: t.replace("{ns}", f"{c.name}.s{{k}}")
    files = [(at(c, f), c.language) for c in cases for f in c.files]
    symbols = [(at(c, f), name, qualified, kind, line) for c in cases for f, own in c.files.items() for name, qualified, kind, line in own]
    deps = [(at(c, d[0]), c.language, d[1], named(c, d[2]), at(c, d[3]), *d[4:]) for c in cases for d in c.edges]
    calls = [(at(c, x[0]), c.language, x[1], named(c, x[2]), x[3]) for c in cases for x in c.calls]
    f = _generated(spark, sf, files, ["path", "language"]).distinct().withColumn("id", _id(F.col("path")))
    s = _generated(spark, sf, symbols, ["path", "name", "qualified_name", "kind", "start_line"]).withColumn("file_id", _id(F.col("path")))
    d = _generated(spark, sf, deps, ["source_file", "language", "kind", "target", "resolved_file", "local_alias", "imported_symbol", "line"]).withColumn("source_file_id", _id(F.col("source_file")))
    c = _generated(spark, sf, calls, ["file", "language", "caller", "callee", "line"])
    c = c.withColumn("source_file_id", _id(F.col("file"))).withColumn("id", F.xxhash64("file", "caller", "callee", "line"))
    c = c.withColumn("callee_file", F.lit(None).cast("string")).withColumn("confidence", F.lit(0.55))
    d, f, s = materialize_bounded(d), materialize_bounded(f), materialize_bounded(s)  # each arm reads them
    return arms.resolve_calls(c, d, f, s).select("file", "caller", "callee", "callee_file", "confidence")


def _register_calls(family: str) -> None:
    cases = CASES[family]
    rows = [(f"{c.name}/s{{k}}/{x[0]}", x[1], x[2].replace("{ns}", f"{c.name}.s{{k}}"), None if x[4] is None else f"{c.name}/s{{k}}/{x[4]}", x[5]) for c in cases for x in c.calls]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _resolved(spark, sf, cases)

    run.__name__ = f"calls_{family}"
    run.__doc__ = f"Targets of {family} calls in every case of the resolution, for every supplier."
    query(_expected(rows, ["file", "caller", "callee", "callee_file", "confidence"], ["string"] * 4 + ["DOUBLE"]))(run)


for _family in CASES:
    _register_calls(_family)
