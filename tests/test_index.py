"""Trees on disk to tables: scope, index, incremental runs, resolution; streams; records."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph, incremental, index, lookup, overview, planning, resolve, semantic
from codeloom.sources import records, tree
from codeloom.streaming import tail

TREE = {
    "app/main.py": "from .util import helper\nfrom . import util\n\ndef main():\n    helper()\n    util.other()\n    own()\n\ndef own():\n    pass\n",
    "app/util.py": "def helper():\n    return other()\n\ndef other():\n    return 1\n",
    "app/__init__.py": "",
    "app/broken.py": "def (\n",
    "web/a.ts": "import { go as run } from './barrel';\nexport function start() { run(); }\n",
    "web/barrel.ts": "export { go } from './b';\n",
    "web/b.ts": "export function go() { return 1; }\n",
    "src/main.c": '#include "one.h"\nint main(void) { return twice(); }\n',
    "src/one.h": "int twice(void) { return 2; }\n",
    "go.mod": "module x.org/app\n",
    "cmd/run.go": 'package main\nimport "x.org/app/tool"\nfunc main() { tool.Do() }\n',
    "tool/doc.go": "package tool\n",
    "tool/do.go": "package tool\nfunc Do() {}\n",
    "node_modules/dep/index.js": "function no() {}\n",
    "notes.txt": "nothing",
    "bad.py": b"\xff\xfe",
}


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tree"))
    write(d, TREE)
    return d


@pytest.fixture(scope="module")
def built(spark, root):
    return index.index_tree(spark, root)


def test_scan(spark, root):
    rows = {r["path"]: r for r in tree.read_tree(spark, root).collect()}
    assert set(rows) == {p for p in TREE if p.endswith((".py", ".ts", ".c", ".h", ".go")) and not p.startswith("node_modules")}
    assert rows["bad.py"]["text"] is None and rows["bad.py"]["error"] == "read: invalid UTF-8"
    assert (rows["app/main.py"]["language"], rows["app/main.py"]["line_count"], rows["app/__init__.py"]["line_count"]) == ("python", 10, 0)
    scoped = tree.read_tree(spark, root, tree.Scope(["app", "web/*.ts"], ["**/util.py"])).select("path").collect()
    assert {r[0] for r in scoped} == {"app/main.py", "app/__init__.py", "app/broken.py", "web/a.ts", "web/barrel.ts", "web/b.ts"}


def test_executors_walk_what_the_driver_leaves(spark, root, monkeypatch):
    whole = sorted(map(str, tree.read_tree(spark, root).collect()))
    monkeypatch.setattr(tree, "FRONTIER", 2)
    assert tree.Walker(root, tree.Scope()).walk([""], 2)[1] and sorted(map(str, tree.read_tree(spark, root).collect())) == whole


def test_folders_that_cannot_be_listed(spark, tmp_path, monkeypatch):
    write(str(tmp_path), {"a.py": "x = 1\n", "in/b.py": "y = 2\n"})
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: real(p) if not str(p).endswith("/in") else (_ for _ in ()).throw(PermissionError(13, "Permission denied", p)))
    rows = {r["path"]: r["error"] for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert rows == {"a.py": None, "in": "walk: Permission denied"}


def test_scope_rules():
    assert tree.walk_roots(["src/a/*.py", "src", "docs/{a,b}"]) == ["src", "docs"]
    assert tree.walk_roots([]) == [""]
    scope = tree.Scope(["src/**/*.py", "lib"], ["src/gen"])
    assert [scope.matches(p) for p in ("src/x.py", "src/a/b.py", "src/gen/x.py", "lib/z/q.c", "other.py")] == [True, True, False, True, False]


def test_index_tables(built):
    assert {(r["path"]) for r in built.errors.collect()} == {"app/broken.py", "bad.py"}
    found = {(r["source_file"], r["target"]): r["resolved_file"] for r in built.dependencies.collect()}
    assert found["app/main.py", ".util.helper"] == "app/util.py"
    assert found["web/a.ts", "./barrel"] == "web/barrel.ts"
    assert found["src/main.c", "one.h"] == "src/one.h"
    assert found["cmd/run.go", "x.org/app/tool"] == "tool/do.go"
    calls = {(r["file"], r["callee"]): (r["callee_file"], r["confidence"]) for r in built.calls.collect()}
    assert calls["app/main.py", "helper"] == ("app/util.py", 0.72)
    assert calls["app/main.py", "util.other"] == ("app/util.py", 0.72)
    assert calls["app/main.py", "own"] == ("app/main.py", 0.72)
    assert calls["src/main.c", "twice"] == ("src/one.h", 0.72)
    assert calls["cmd/run.go", "tool.Do"] == ("tool/do.go", 0.72)
    assert calls["web/a.ts", "run"] == ("web/b.ts", 0.72)
    row = built.report().first()
    assert row["files"] == 12 and row["errors"] == 2


def test_second_run_parses_only_what_changed(spark, root, built, tmp_path, monkeypatch):
    kept = index.select_previous(built, str(tmp_path / "store"))
    write(root, {"app/util.py": TREE["app/util.py"] + "\ndef more():\n    return helper()\n"})
    os.remove(os.path.join(root, "web/b.ts"))
    parsed = []
    real = index.extract_files
    monkeypatch.setattr(index, "extract_files", lambda df: parsed.append({r["path"] for r in df.select("path").collect()}) or real(df))
    again = index.index_tree(spark, root, previous=kept)
    assert parsed[0] == {"app/util.py"}
    whole = index.index_tree(spark, root)
    for table, key in (("files", ["path", "hash"]), ("symbols", ["path", "qualified_name"]), ("dependencies", ["source_file", "target", "resolved_file"]), ("calls", ["file", "callee", "callee_file", "confidence"])):
        rows = lambda i: sorted(map(str, getattr(i, table).select(*key).collect()))  # noqa: B023, E731
        assert rows(again) == rows(whole), table
    assert not any(r["path"] == "web/b.ts" for r in again.files.collect())


def test_overview_of_an_index(built):
    best = overview.entrypoints(built.files, built.symbols).first()
    assert (best["path"], best["score"], best["reason"]) == ("app/main.py", 110, "entry symbol named main")
    assert {r["language"] for r in overview.languages(built.files).collect()} == {"python", "typescript", "c", "go"}
    edges = built.dependencies.select("source_file", "target", "resolved_file", "kind", "language", F.col("line"))
    assert graph.page(edges, list(graph.EDGE_ORDER), 2).filter("has_more").count() == 2
    with pytest.raises(ValueError):
        graph.page(edges, ["line"], 0)


def test_config(tmp_path):
    d = str(tmp_path)
    assert tree.load_config(d) == tree.Config()
    write(d, {"Cargo.toml": "", "package.json": "{}"})
    path = tree.write_config(d)
    assert tree.load_config(d).test_commands == ["cargo test", "npm test"]
    with pytest.raises(FileExistsError):
        tree.write_config(d)
    with open(path, "w") as f:
        f.write("include = [")
    with pytest.raises(ValueError):
        tree.load_config(d)


def test_config_status(spark, tmp_path):
    row = tree.config_status(spark, str(tmp_path)).first()
    assert (row["exists"], row["loaded"], row["overrides"]) == (False, False, False)


def test_records(spark, tmp_path):
    d = str(tmp_path)
    write(d, {"e.json": '{"provider": "p", "candidates": [{"file": "a", "score": 1.5}, {"file": "b"}, {"file": "c"}]}', "t.tsv": "# note\nfind it\tsrc/a.py\n\nother\tsrc/b.py\tseed\n"})
    row = records.cut_candidates(records.read_evidence(spark, f"{d}/e.json"), 2).first()
    assert (row["provider"], row["total"], row["omitted"], [c["file"] for c in row["candidates"]]) == ("p", 3, 1, ["a", "b"])
    rows = records.read_expectations(spark, f"{d}/t.tsv").orderBy("task").collect()
    assert [(r["task"], r["first_file"], r["seed_file"]) for r in rows] == [("find it", "src/a.py", None), ("other", "src/b.py", "seed")]


def test_chunk_diff_keeps_adds_updates_removes(spark):
    schema = "file string, start_line long, end_line long, content_hash string"
    old = spark.createDataFrame([("a", 1, 4, "x"), ("a", 5, 8, "y"), ("b", 1, 2, "z")], schema)
    new = spark.createDataFrame([("a", 1, 4, "x"), ("a", 5, 8, "Y"), ("c", 1, 1, "w")], schema)
    diff = incremental.chunk_diff(old, new)
    assert {(r["file"], r["start_line"]): r["change"] for r in diff.collect()} == {("a", 5): "updated", ("b", 1): "removed", ("c", 1): "added"}
    assert incremental.kept_vectors(old.drop("content_hash"), diff).count() == 1
    assert incremental.chunk_diff(old, old).count() == 0


def test_fingerprint_follows_content(spark):
    f = lambda rows, c: incremental.fingerprint(spark.createDataFrame(rows, "path string, hash string"), c).first()[0]
    one = f([("a", "1"), ("b", None)], ["import"])
    assert one == f([("b", None), ("a", "1")], ["import"])
    assert len({one, f([("a", "2"), ("b", None)], ["import"]), f([("a", "1"), ("b", None)], ["node"])}) == 3


def test_embeddings(spark):
    v = semantic.hash_vector("Hello hello_1 wörld")
    assert v.shape == (64,) and abs(float((v * v).sum()) - 1) < 1e-5
    assert (semantic.hash_vector("HELLO") == semantic.hash_vector("hello")).all() and semantic.hash_vector("").any()
    chunks = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", "three")], "id string, text string")
    found = semantic.vector_search(semantic.embed(chunks, ["id"]), semantic.hash_vector("one two").tolist(), limit=2).collect()
    assert [(r["id"], r["score"]) for r in found] == [("a", 1.0), ("b", 1.0)]


def test_references(spark):
    texts = spark.createDataFrame([("src/a.py", "import run\ndef run():\n    pass\n# run\nrun()\nx = run\nrun = 1\nrunner()"), ("tests/a.py", "run()")], "path string, text string")
    rows = lookup.find_references(texts, "run", include_definitions=True).collect()
    assert {(r["path"], r["line"], r["kind"]) for r in rows} == {
        ("src/a.py", 1, "import"), ("src/a.py", 2, "definition"), ("src/a.py", 5, "call"), ("src/a.py", 6, "read"), ("src/a.py", 7, "assignment"), ("tests/a.py", 1, "call"),
    }
    assert min(r["confidence"] for r in rows if r["kind"] == "call") == 0.65


def test_planning_rules(spark):
    cut = planning.budget_cut(spark.createDataFrame([("a", 3, 300), ("b", 2, 300), ("c", 1, 10)], "file string, score int, tokens long"), 20)
    assert [(r["file"], r["selected"]) for r in cut.orderBy("rank").collect()] == [("a", True), ("b", False), ("c", False)]
    rows = [("p", "s", True, "m", "e", "f"), (None, "s", True, "m", "e", "f"), (None, "s", False, None, None, None), (None, None, None, "m", "e", None), (None, None, None, None, "e", "f"), (None, None, None, None, None, "f"), (None,) * 6]
    seeds = planning.infer_seed(spark.createDataFrame(rows, "explicit string, task_path string, path_indexed boolean, task_match string, entrypoint string, source_file string"))
    assert [r["strategy"] for r in seeds.collect()] == ["explicit", "auto_task_path", "auto_task_path_unindexed", "auto_task_match", "auto_entrypoint", "auto_source_fallback", "auto_no_seed"]
    routes = [("a", ["a"], None), ("a", ["a"], []), (None, [], ["x"]), ("a", ["a"], ["a", "x"]), ("a", ["a", "b"], ["b"]), ("a", ["a"], ["x"])]
    got = planning.agreement(spark.createDataFrame(routes, "first_file string, selected array<string>, backend array<string>"))
    assert [r["agreement"] for r in got.collect()] == ["no_backend", "backend_without_candidates", "no_local_route", "agree", "overlap", "conflict"]


def test_budget_ranks_all_candidates(spark):
    rows = [(f"f{i:05d}", i * 7919 % 13, i % 3 if i % 13 else 0) for i in range(12_000)] + [("none", None, None)]
    cut = planning.budget_cut(spark.createDataFrame(rows, "file string, score int, tokens long"), 11_000).collect()
    expected, total = {}, 0
    for rank, (file, _, tokens) in enumerate(sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])), 1):
        total += tokens or 0
        expected[file] = (rank, total, total <= 11_000)
    assert len(cut) == 12_001 and {r["file"]: (r["rank"], r["running_tokens"], r["selected"]) for r in cut} == expected


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    rows = resolve.closure(edges, spark.createDataFrame([("a",), ("d",)], "start string")).collect()
    assert {(r["start"], r["node"]) for r in rows} == {("a", x) for x in "abc"} | {("d", x) for x in "abcd"}


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    for name, df in (("counts", tail.event_counts(stream)), ("sessions", tail.event_sessions(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").start()
        q.processAllAvailable()
        q.stop()
    want = tail.event_counts(events).count()
    assert spark.table("counts").count() == want
    seen = []
    q = tail.follow(spark, folder, ", ".join(f"{c} {t}" for c, t in events.dtypes), str(tmp_path / "ck"), lambda df, n: seen.append(df.count()))
    q.awaitTermination(60)
    assert sum(seen) == events.count()


def test_late_events_are_left_out(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    schema, folder = "ts timestamp, event_type string, value double", str(tmp_path / "late")
    spark.createDataFrame([(at(10), "a", 1.0)], schema).coalesce(1).write.mode("append").parquet(folder)
    q = tail.event_counts(spark.readStream.schema(schema).parquet(folder), late="1 hour").writeStream.format("memory").queryName("late").outputMode("append").start()
    q.processAllAvailable()
    for rows in ([(at(15), "a", 1.0)], [(at(8), "a", 1.0)], [(at(20), "a", 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        q.processAllAvailable()
    q.stop()
    assert {r["start"].hour for r in spark.table("late").collect()} == {10, 15}


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    from codeloom.operators import scratch

    monkeypatch.setattr(scratch, "scratch_dir", lambda s: f"file://{tmp_path}/rounds")
    assert scratch.materialize(spark.range(3)).count() == 3 and os.listdir(f"{tmp_path}/rounds")
    scratch.clear_scratch(spark)
    assert not os.path.exists(f"{tmp_path}/rounds")
