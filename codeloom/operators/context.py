"""What to read first: ranges of lines from all kinds of evidence, merged, trimmed and cut to a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import planning

#: Lines around a line that is evidence, by source.
AROUND = {"type_relation": (2, 10), "call_graph": (3, 3), "reference": (2, 2), "dependency": (1, 1)}
#: Lines of a file that is evidence as a whole, and of the longest range that is given.
HEAD_LINES, MOST_LINES = 40, 120
TOKENS_PER_LINE = 10


def ranges(rows: DataFrame, source: str, score: int, start: str = "start_line", end: str = "end_line", file: str = "file") -> DataFrame:
    """(file, start_line, end_line, source, base) of rows that have a range."""
    return rows.select(F.col(file).alias("file"), F.col(start).cast("long").alias("start_line"), F.col(end).cast("long").alias("end_line"), F.lit(source).alias("source"), F.lit(score).alias("base"))


def around(rows: DataFrame, source: str, score: int, line: str = "line", file: str = "file") -> DataFrame:
    """The same of rows that have a line."""
    before, after = AROUND[source]
    return ranges(rows.withColumn("_s", F.greatest(F.lit(1), F.col(line) - before)).withColumn("_e", F.col(line) + after), source, score, "_s", "_e", file)


def heads(rows: DataFrame, source: str, score: int, file: str = "file") -> DataFrame:
    """The same of rows that only have a file: its first lines."""
    return ranges(rows.withColumn("_s", F.lit(1)).withColumn("_e", F.lit(HEAD_LINES)), source, score, "_s", "_e", file)


def candidates(parts: list[DataFrame], files: DataFrame, boost: Column, most_lines: int = MOST_LINES) -> DataFrame:
    """Ranges of ``parts`` within ``files`` (file, line_count): merged, trimmed, with score, sources, lines and tokens.

    Ranges that overlap or touch become one, with the best base and all sources; no line
    occurs twice. ``boost`` is added to the base, by the path.
    """
    united = reduce(DataFrame.unionByName, parts).join(files, "file")
    clipped = united.withColumn("end_line", F.least("end_line", F.greatest("line_count", F.lit(1)))).filter("start_line <= end_line")
    merged = planning.merge_ranges(clipped.select("file", "start_line", "end_line", "source", "base"), 1, (F.max("base").alias("base"), F.array_sort(F.collect_set("source")).alias("sources")))
    trimmed = planning.trim_ranges(merged, most_lines)
    lines = F.col("end_line") - F.col("start_line") + 1
    return trimmed.withColumn("score", F.col("base") + boost).withColumn("lines", lines).withColumn("tokens", (lines * TOKENS_PER_LINE).cast("long")).drop("base", "merged")


def by_file(ranked: DataFrame) -> DataFrame:
    """(file, rank, score, ranges, lines, tokens) of ranges: a file stands where its best range does."""
    return ranked.groupBy("file").agg(
        F.min("rank").alias("rank"), F.max("score").alias("score"), F.count("*").alias("ranges"), F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens")
    )


def location_map(selected: DataFrame) -> DataFrame:
    """One row: files to their ranges as 'start-end' in line order. The budget bounds it."""
    text = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    own = selected.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", text.alias("t")))), lambda r: r["t"]).alias("locations"))
    return own.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "locations")))).alias("locations"))
