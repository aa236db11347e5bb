"""Dependency graph: filters, pages, summaries and tops over one edge table.

Edges have source_file, target, resolved_file, kind, language and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import is_local

#: IN lists up to this long become a predicate that reaches the scan; longer ones a semi-join.
INLINE_VALUES = 1000
EDGE_ORDER = ("source_file", "line", "target", "resolved_file", "kind", "language")


def _one_of(df: DataFrame, condition, values: list[str]) -> DataFrame:
    if len(values) <= INLINE_VALUES:
        return df.filter(condition(lambda c: c.isin(*values)))
    listed = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], "_v string")
    return df.join(listed, condition(lambda c: c.eqNullSafe(listed["_v"]) & c.isNotNull()), "left_semi")


def filter_edges(edges: DataFrame, files: list[str] | None = None, languages: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Conjunction of the lists that are given; a file matches as source or as resolved target."""
    if languages:
        edges = _one_of(edges, lambda f: f(edges["language"]), languages)
    if kinds:
        edges = _one_of(edges, lambda f: f(edges["kind"]), kinds)
    if files:
        if len(files) <= INLINE_VALUES:
            return edges.filter(F.col("source_file").isin(*files) | F.col("resolved_file").isin(*files))
        # Two equi-joins in place of one join on OR; a row that both find counts once.
        listed = edges.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(files)], "_v string")
        by_source = edges.join(listed, edges["source_file"] == listed["_v"], "left_semi")
        rest = edges.join(listed, edges["source_file"] == listed["_v"], "left_anti")
        return by_source.unionByName(rest.join(listed, rest["resolved_file"] == listed["_v"], "left_semi"))
    return edges


def page(df: DataFrame, order: list[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit of a total order, with has_more from one row of look-ahead."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    # The look-ahead row is counted on the page itself, so the edges are scanned once.
    ahead = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = ahead.withColumn("_nth", F.row_number().over(W.orderBy(*order))).withColumn("has_more", F.count("*").over(W.partitionBy()) > limit)
    return numbered.filter(F.col("_nth") <= limit).drop("_nth")


def summary(edges: DataFrame, relation_kind: str = "base_type") -> DataFrame:
    """One row of counts. External edges are all edges that are not local."""
    local = is_local(F.col("resolved_file"))
    return edges.agg(
        F.count("*").alias("edges"),
        F.count("resolved_file").alias("resolved"),
        F.count_if(local).alias("local"),
        (F.count("*") - F.count_if(local)).alias("external"),
        F.count_if(F.col("resolved_file").isNull()).alias("unresolved"),
        F.count_if(F.col("kind") == relation_kind).alias("type_relation"),
        F.count_distinct(F.when(~local | F.col("resolved_file").isNull(), F.col("target"))).alias("external_targets"),
    )


def node_count(edges: DataFrame) -> DataFrame:
    """Distinct paths and raw targets; a file that is also named by a target counts for both."""
    nodes = edges.select(F.col("source_file").alias("node")).union(edges.select("target")).distinct()
    return nodes.agg(F.count("*").alias("nodes"))


def top(df: DataFrame, key: str | Column, name: str, n: int = 12) -> DataFrame:
    """The ``n`` most frequent values of ``key``, ties by value; nulls are left out."""
    column = F.col(key) if isinstance(key, str) else key
    counted = df.filter(column.isNotNull()).groupBy(column.alias(name)).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), name).limit(n)


def top_external(edges: DataFrame, n: int = 12) -> DataFrame:
    return top(edges.filter(~F.coalesce(is_local(F.col("resolved_file")), F.lit(False))), "target", "target", n)


def top_relations(edges: DataFrame, relation_kind: str = "base_type", n: int = 12) -> DataFrame:
    return top(edges.filter(F.col("kind") == relation_kind), "target", "target", n)
