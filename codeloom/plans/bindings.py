"""The driver tables seen as the tables of a code graph, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string")).alias("path"),
        F.col("lang").alias("language"),
        F.sha2("text", 256).alias("hash"),
        (newlines + 1).cast("long").alias("line_count"),
        F.col("n_chars").alias("size"),
    )


FILES = """files AS (SELECT doc_id AS id, source || '/' || lang || '/doc_' || doc_id AS path, lang AS language, sha256(text) AS hash,
 CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS line_count, n_chars AS size FROM documents)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        (F.col("p_partkey") % 200).alias("file_id"),
        F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"),
        F.col("p_type").alias("kind"),
        F.col("p_size").cast("long").alias("start_line"),
        (F.col("p_size") + 10).cast("long").alias("end_line"),
    )


SYMBOLS = """symbols AS (SELECT p_partkey AS id, p_partkey % 200 AS file_id, p_name AS name, p_brand || '.' || p_name AS qualified_name,
 p_type AS kind, CAST(p_size AS BIGINT) AS start_line, CAST(p_size + 10 AS BIGINT) AS end_line FROM part)"""


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from lineitem; part and supplier are joined by key, by broadcast while they are small."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    own = line.join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    return own.select(
        F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("source_file"),
        F.col("p_name").alias("target"),
        F.when(F.col("l_returnflag") != "R", F.col("s_name")).alias("resolved_file"),
        F.col("l_linestatus").alias("kind"),
        F.col("l_returnflag").alias("language"),
        F.col("l_linenumber").cast("long").alias("line"),
    )


DEPENDENCIES = """deps AS (SELECT 'order/' || l_orderkey AS source_file, p_name AS target, CASE WHEN l_returnflag <> 'R' THEN s_name END AS resolved_file,
 l_linestatus AS kind, l_returnflag AS language, CAST(l_linenumber AS BIGINT) AS line
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("caller"),
        F.concat(F.lit("svc."), "event_type").alias("callee"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("svc/"), "event_type")).alias("callee_file"),
        F.concat(F.lit("day/"), F.dayofmonth("ts").cast("string")).alias("file"),
        F.minute("ts").cast("long").alias("line"),
        F.when(F.col("event_id") % 2 == 0, 0.72).otherwise(0.55).alias("confidence"),
    )


CALLS = """calls AS (SELECT event_id AS id, 'user.' || user_id AS caller, 'svc.' || event_type AS callee,
 CASE WHEN event_id % 3 = 0 THEN 'svc/' || event_type END AS callee_file, 'day/' || day(ts) AS file, CAST(minute(ts) AS BIGINT) AS line,
 CAST(CASE WHEN event_id % 2 = 0 THEN 0.72 ELSE 0.55 END AS DOUBLE) AS confidence FROM events)"""


def walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph: nations to their customers, customers to their orders' priorities, priorities back to nations."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    name = F.concat(F.lit("cust/"), F.col("c_custkey").cast("string"))
    first = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("src"), name.alias("dst"))
    second = o.select(F.concat(F.lit("cust/"), F.col("o_custkey").cast("string")).alias("src"), F.col("o_orderpriority").alias("dst"))
    third = o.select("o_orderpriority", "o_custkey").distinct()
    third = third.join(c, third["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("o_orderpriority").alias("src"), F.col("n_name").alias("dst"))
    return first.unionByName(second).unionByName(third).distinct()


WALK_EDGES = """edges AS (SELECT n_name AS src, 'cust/' || c_custkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION SELECT 'cust/' || o_custkey, o_orderpriority FROM orders
 UNION SELECT o_orderpriority, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def chunk_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stored, desired) chunks of documents: the desired side has edited texts and lacks others, the stored side too."""
    from codeloom.operators.semantic import chunk_windows

    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), "text")
    stored = chunk_windows(d.filter("doc_id % 11 <> 3").select("file", "text"), 4)
    edited = F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    desired = chunk_windows(d.filter("doc_id % 13 <> 5").select("file", edited.alias("text")), 4)
    return stored, desired


def _windows(source: str, name: str, lines: int) -> str:
    """DuckDB text of the chunk windows of (file, text)."""
    return f"""{name}_lines AS (SELECT file, CASE WHEN text IS NULL OR text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2]
 ELSE string_split(text, chr(10)) END AS ls FROM {source}),
{name} AS (SELECT file, CAST(i + 1 AS BIGINT) AS start_line, CAST(least(i + {lines}, len(ls)) AS BIGINT) AS end_line,
 sha256(array_to_string(ls[i + 1 : i + {lines}], chr(10))) AS content_hash, CAST(ceil(length(array_to_string(ls[i + 1 : i + {lines}], chr(10))) / 4.0) AS BIGINT) AS token_estimate,
 array_to_string(ls[i + 1 : i + {lines}], chr(10)) AS text
 FROM (SELECT file, ls, unnest(range(0, len(ls), {lines})) AS i FROM {name}_lines))"""


STORED = "s0 AS (SELECT 'doc/' || doc_id AS file, text FROM documents WHERE doc_id % 11 <> 3), " + _windows("s0", "stored", 4)
DESIRED = (
    "d0 AS (SELECT 'doc/' || doc_id AS file, CASE WHEN doc_id % 7 = 1 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 5), "
    + _windows("d0", "desired", 4)
)
CHUNKS = "c0 AS (SELECT 'doc/' || doc_id AS file, text FROM documents), " + _windows("c0", "chunks", 5)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.operators.semantic import chunk_windows

    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), "text")
    return chunk_windows(d, 5)
