"""What shows on larger tables only, made small."""

from __future__ import annotations

import time

import duckdb
from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.functions.names import line_count
from codeloom.operators import index, resolve
from tests import oracle


def test_quotients_of_embeddings_are_rounded_as_whole_numbers_are(spark, tmp_path):
    pairs = [("w0", "w30"), ("w0", "w43"), ("w0", "w45"), ("w0", "w49")]  # 9 / 8 = 1.125, which floats put just below
    texts = [" ".join([a] * 8 + [b] * 9) for a, b in pairs] + ["Eser " * 40 + "ung", "", "É", "\u212aelvin", "İi", "ΑΣ", "one\ntwo\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = catalog.QUERIES["hash_embeddings"](spark, str(tmp_path))
    assert oracle.spark_rows(got) == oracle.duck_rows(con, catalog.ORACLE_SQL["hash_embeddings"])


def test_path_endings_of_many_folders_do_not_meet_all_of_each_other(spark):
    few = [("Lib/User.cs",), ("/b/User.cs",), ("ib/User.cs",), ("/Lib/User.cs",), ("ser.cs",), ("x/a/b/USER.cs",), ("User.cs/",)]
    paths = ["a/Lib/User.cs", "Lib/User.cs", "b/User.cs", "ax/a/b/User.cs", "User.cs", "a/Glib/User.cs", "a/b/User.cs/c"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = resolve.path_suffix_join(spark.createDataFrame(few, "suffix string"), "suffix", files).collect()
    assert sorted((r.suffix, r.path) for r in got) == sorted((s, p) for (s,) in few for p in paths if p.lower().endswith(s.lower()))

    n = 20_000  # 400 million pairs of equal last parts, and of equal last three
    one = spark.range(n)
    files = one.select(F.format_string("s%d/Lib/User.cs", "id").alias("path")).unionByName(one.select(F.format_string("wild/s%d/src/b/tools/Tool.java", "id").alias("path")))
    ends = one.select(F.format_string("this%d/User.cs", "id").alias("suffix")).unionByName(one.select(F.format_string("s%d/src/b/tools/Tool.java", "id").alias("suffix")))
    began = time.monotonic()
    assert resolve.path_suffix_join(ends, "suffix", files).count() >= n
    assert time.monotonic() - began < 30


def test_names_of_globs_travel_as_sets(spark):
    targets = [(f"t{t}", f"n{i}") for t in range(40) for i in range(20 * t, 20 * t + 200)] + [("t0", None), ("t1", None), ("t50", "n1")]
    globs = [(f"f{k}", f"t{t}") for k in range(300) for t in (k % 40, k * 7 % 40, k * 3 % 60)] + [("g", "t0"), (None, "t39")]
    offers = {}
    for f, t in set(globs):
        for n in {n for x, n in targets if x == t}:
            offers.setdefault((f, n), []).append(t)
    want = {(f, n, t[0]) for (f, n), t in offers.items() if len(t) == 1}
    left, right = spark.createDataFrame(globs, "file string, target string"), spark.createDataFrame(targets, "target string, name string")
    found = resolve.unambiguous_globs(left, right)
    got = [(r.file, r.name, r.target) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "_bits" in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each name and glob is dealt


def _broadcast_bytes(spark, after: int) -> list[int]:
    """Sizes of the tables that executions past ``after`` sent to all executors."""
    store, units = spark._jsparkSession.sharedState().statusStore(), {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    out, executions = [], store.executionsList()
    for e in (executions.apply(i) for i in range(executions.size())):
        if e.executionId() <= after:
            continue
        metrics, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if node.name() == "BroadcastExchange" and m.name() == "data size" and metrics.contains(m.accumulatorId()):
                    number, unit = metrics.apply(m.accumulatorId()).split("\n")[-1].split(" ")[:2]
                    out.append(int(float(number.replace(",", "")) * units[unit]))
    return out


def test_index_broadcasts_no_table_that_only_its_files_make_look_small(spark):
    n = 12_000  # a written table of so many like paths has a few hundred KB
    folder = "a/folder/of/very/much/the/same/name/" * 4
    rows = spark.range(n).select(
        F.format_string(folder + "m%d.sh", "id").alias("path"), F.lit("bash").alias("language"), F.format_string("source ./m%d.sh\nf%d() {\n  f%d\n}\n", (F.col("id") + 1) % n, "id", (F.col("id") + 1) % n).alias("text")
    )
    files = rows.withColumn("error", F.lit(None).cast("string")).withColumn("size", F.length("text").cast("long")).withColumn("modified", F.lit(0).cast("long")).withColumn("hash", F.sha2("text", 256))
    files = files.withColumn("line_count", line_count(F.col("text")))
    spark.range(1).count()
    before = spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()
    built = index.build_index(files)
    counts = built.report().first().asDict()
    assert (counts["files"], counts["lines"], counts["symbols"], counts["dependencies"], counts["errors"]) == (n, 4 * n, n, n, 0)
    leads = built.calls.filter("callee_file is not null").select("file", "callee_file").distinct()
    at = F.regexp_extract("file", r"m(\d+)\.sh", 1).cast("long")
    assert leads.filter(F.col("callee_file") != F.concat(F.lit(folder + "m"), ((at + 1) % n).cast("string"), F.lit(".sh"))).count() == 0 and leads.count() == n
    sent = _broadcast_bytes(spark, before)
    assert sent and max(sent) < 1_000_000  # the paths alone are 1.9 MB
