"""Project overview: totals, groups and entrypoint candidates.

Files have id, path, language, line_count; symbols file_id, name, qualified_name, kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import directory_key, entrypoint_confidence, entrypoint_priority, file_entrypoint, path_role, symbol_entrypoint


def totals(files: DataFrame, symbols: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of counts over the four tables; each is reduced to one row before they meet."""
    own = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))
    for df, name in ((symbols, "symbols"), (edges, "dependencies"), (calls, "calls")):
        own = own.join(F.broadcast(df.agg(F.count("*").alias(name))))
    return own


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines")).orderBy(F.desc("files"), "language")


def top_directories(files: DataFrame, n: int = 12) -> DataFrame:
    own = files.groupBy(directory_key(F.col("path")).alias("directory")).agg(F.count("*").alias("files"))
    return own.orderBy(F.desc("files"), "directory").limit(n)


def main_directories(files: DataFrame, symbols: DataFrame, n: int = 12) -> DataFrame:
    """Files, lines and symbols of each directory; symbols are counted by file before the join."""
    per_file = symbols.groupBy("file_id").agg(F.count("*").alias("_n"))
    own = files.join(per_file, files["id"] == per_file["file_id"], "left")
    grouped = own.groupBy(directory_key(F.col("path")).alias("directory")).agg(
        F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.coalesce(F.sum("_n"), F.lit(0)).alias("symbols")
    )
    return grouped.withColumn("role", path_role(F.col("directory"))).orderBy(F.desc("files"), "directory").limit(n)


def symbol_kinds(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def call_summary(calls: DataFrame) -> DataFrame:
    return calls.agg(
        F.count("*").alias("edges"), F.count("callee_file").alias("resolved"), (F.count("*") - F.count("callee_file")).alias("unresolved")
    )


def entrypoints(files: DataFrame, symbols: DataFrame, n: int = 12) -> DataFrame:
    """The best signal of each file, its own name's before its symbols' on equal scores.

    A file whose best signal is its name keeps the first entry-like symbol as a hint.
    """
    by_name = files.select("path", "language", file_entrypoint(F.col("path")).alias("_s"), F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("_turn"))
    entry = symbols.withColumn("_s", symbol_entrypoint(F.col("name"))).filter("_s is not null").select("file_id", "_s", F.col("qualified_name").alias("symbol"))
    by_symbol = files.join(entry, files["id"] == entry["file_id"]).select("path", "language", "_s", "symbol", F.lit(1).alias("_turn"))
    signals = by_name.filter("_s is not null").unionByName(by_symbol)
    # Highest score first; among equals the name, then symbols in order.
    order = F.struct(-F.col("_s.score"), F.col("_turn"), F.coalesce("symbol", F.lit("")))
    best = signals.groupBy("path", "language").agg(
        F.min_by(F.struct("_s.score", "_s.reason", "symbol"), order).alias("_best"), F.min("symbol").alias("_any")
    )
    score = F.col("_best.score")
    ranked = best.select(
        "path",
        "language",
        path_role(F.col("path")).alias("role"),
        score.alias("score"),
        entrypoint_confidence(score).alias("confidence"),
        F.col("_best.reason").alias("reason"),
        F.coalesce("_best.symbol", "_any").alias("symbol"),
    )
    return ranked.orderBy(F.desc(score + entrypoint_priority(F.col("path"))), "path").limit(n)


def summary_text(totals_row: dict, language: str | None, directory: str | None) -> str:
    """One sentence of the totals, for people."""
    return (
        f"{totals_row['files']} indexed files, {totals_row['lines']} lines, {totals_row['symbols']} symbols, "
        f"{totals_row['dependencies']} dependency edges, {totals_row['type_relation']} type-relation edges, {totals_row['calls']} call edges. "
        f"Primary language: {language or 'none'}. Largest directory: {directory or '.'}."
    )
