"""Additions that Spark gives for free: event-time windows, rollups, ranks, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.plans import bindings as b
from codeloom.plans.registry import query


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = b.table(spark, sf, "events")
    own = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return own.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = b.table(spark, sf, "events")
    own = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT lang, source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_overview(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents").rollup("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query(
    """SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS nth, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def call_sequence(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = b.table(spark, sf, "events")
    return e.select("event_id", F.row_number().over(w).alias("nth"), F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"))


@query(
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signed_up
 FROM events"""
)
def asof_signup(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join of events to the last sign-up before them: one sort by user, no range join."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = b.table(spark, sf, "events")
    return e.select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("ts")), ignorenulls=True).over(w).alias("signed_up"))


@query(
    """SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    line = b.table(spark, sf, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    return line.groupBy(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus")).agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )
