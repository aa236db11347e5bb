"""One scenario over a generated tree, through the tools; arguments; resolution by language."""

from __future__ import annotations

import io
import json

import pytest

from codeloom.api import TOOLS, Project, freshness, parse_location, repository_fingerprint, task_terms
from codeloom.cli import serve
from codeloom.operators import index
from tests.test_index import write

TREE = {
    "main.py": "from app.auth import login\n\ndef main():\n    return login('x')\n",
    "app/__init__.py": "",
    "app/auth.py": "from app import store\n\nclass Auth:\n    def check(self):\n        return store.load()\n\ndef login(name):\n    return Auth().check()\n",
    "app/store.py": "def load():\n    return 1\n",
    "tests/test_auth.py": "from app.auth import login\n\ndef test_login():\n    assert login('x')\n",
    "pyproject.toml": "",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("project"))
    write(d, TREE)
    return Project(spark, d)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_index_overview_and_lookups(project):
    assert project.index_project().first()["files"] == 5
    o = project.project_overview()
    assert o["entrypoints"].first()["path"] == "main.py"
    assert o["dependencies"].first()["local"] > 0
    assert project.recommended_next_tools().first()["tool"] == "context_pack"
    assert rows(project.symbol_search("login"), "qualified_name")[0] == ("login",)
    assert rows(project.file_outline("app/auth.py", [(4, 4)]), "qualified_name") == [("Auth",), ("Auth.check",)]
    assert {r[0] for r in rows(project.callers("login"), "file")} == {"main.py", "tests/test_auth.py"}
    assert rows(project.callees("Auth.check"), "callee", "callee_file") == [("store.load", "app/store.py")]
    g = project.dependency_graph(files=["app/store.py"], limit=1)
    assert g["edges"].first()["source_file"] == "app/auth.py"
    assert ("tests/test_auth.py", "call") in rows(project.find_references("login"), "path", "kind")


def test_impact(project):
    got = project.impact_analysis(symbols=["login"], depth=2)
    files = [r[0] for r in rows(got["files"], "file")]
    assert {"app/auth.py", "main.py", "tests/test_auth.py"} <= set(files)
    reasons = {r["file"]: set(r["reasons"]) for r in got["files"].collect()}
    assert "seed_definition" in reasons["app/auth.py"] and {"direct_caller", "dependency_source", "text_reference"} <= reasons["main.py"]
    assert rows(got["checks"], "command")[0] == ("pytest tests/test_auth.py",)
    assert got["risk"].first()["risk"] in ("medium", "high")
    with pytest.raises(ValueError):
        project.impact_analysis()


def test_semantic(project):
    first = project.semantic_index(chunk_lines=4).first()
    assert first["generated"] == first["total"] == first["added"] > 4
    again = project.semantic_index(chunk_lines=4).first()
    assert (again["generated"], again["added"], again["updated"]) == (0, 0, 0)
    status = project.embedding_status().first()
    assert status["vectors"] == status["chunks"] == first["total"]
    assert project.semantic_search("def load return", 1).first()["chunk"].startswith("app/store.py")


def test_context(project):
    pack = project.context_pack("fix the login in app/auth.py")
    assert (pack["strategy"], pack["seed_files"]) == ("auto_task_path", ["app/auth.py"])
    assert pack["files"].first()["file"] == "app/auth.py"
    ranked = [r[0] for r in rows(pack["files"], "file")]
    assert ranked.index("main.py") < ranked.index("tests/test_auth.py")
    tests_first = [r[0] for r in rows(project.context_pack("extend the tests of app/auth.py")["files"], "file")]
    assert tests_first.index("tests/test_auth.py") < tests_first.index("main.py")
    small = project.context_pack("app/auth.py", token_budget=20)
    assert small["applied_budget"] == 500 and small["continuation"].first()["status"] == "minimum_budget_applied"


def test_route(project):
    route = project.agent_route("authentication of users", backend=["main.py"])
    assert route["first_file"] == "app/auth.py" and route["agreement"] == "overlap" and route["quality_score"] > 0
    assert project.agent_route("x", seed_files=["app/store.py:1"])["quality_level"] == "high"


def test_arguments(project):
    for call in (lambda: project.symbol_search(""), lambda: project.callers("x", 0), lambda: project.dependency_graph(files="a"), lambda: project.context_pack(" "), lambda: project.semantic_index(0)):
        with pytest.raises(ValueError):
            call()
    assert parse_location("a/b.py:12:3") == ("a/b.py", 12, 12) and parse_location("a.py#L3-L9") == ("a.py", 3, 9) and parse_location("a.py") == ("a.py", None, None)
    with pytest.raises(ValueError):
        parse_location("a.py#L9-L3")
    assert task_terms("Fix the routing of it") == ["routing", "route", "router", "routes"]


def test_serve(project):
    asked = [{"id": 1, "method": "tools/list"}, {"id": 2, "method": "tools/call", "params": {"name": "callers", "arguments": {"symbol": "login"}}}, {"id": 3, "method": "nope"}, {"id": 4, "method": "callers", "params": {}}]
    out = io.StringIO()
    serve(project, [json.dumps(a) for a in asked] + ["", "{"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got[0]["result"]["tools"]) == len(TOOLS) == 17
    assert {r["file"] for r in got[1]["result"]} == {"main.py", "tests/test_auth.py"}
    assert [g["error"]["code"] for g in got[2:]] == [-32601, -32602, -32700]


def test_freshness(tmp_path):
    assert repository_fingerprint(str(tmp_path)) is None
    assert [freshness(*a) for a in (("a", "a"), ("a", "b"), (None, "b"), ("a", None))] == ["match", "changed", "missing", "non_git"]
    assert freshness("a", "b", forced=True) == "forced"


def test_empty_tree(spark, tmp_path):
    write(str(tmp_path), {"notes.txt": "nothing"})
    p = Project(spark, str(tmp_path))
    assert p.index_project().first()["files"] == 0
    assert p.context_pack("do something")["status"] == "blocked_no_seed"


RESOLUTION = {
    # Java: same package, wildcard import
    "src/a/b/Tool.java": "package a.b;\npublic class Tool {\n  public static int go() { return 1; }\n}\n",
    "src/a/b/Use.java": "package a.b;\npublic class Use {\n  public int run() { return Tool.go(); }\n}\n",
    "src/c/Other.java": "package c;\nimport a.b.*;\npublic class Other {\n  public int run() { return Tool.go(); }\n}\n",
    # C#: namespace type, typed local, property chain, base call, extension method, full name
    "App/Core/User.cs": "namespace App.Core {\n  public class User {\n    public string Name() { return \"\"; }\n    public Mail Box { get; set; }\n  }\n}\n",
    "App/Core/Mail.cs": "namespace App.Core {\n  public class Mail {\n    public void Send() { }\n  }\n}\n",
    "App/Core/Base.cs": "namespace App.Core {\n  public class Base : Root {\n    public void Start() { }\n  }\n}\n",
    "App/Core/Root.cs": "namespace App.Core {\n  public class Root {\n    public void Stop() { }\n  }\n}\n",
    "App/Core/Help.cs": "namespace App.Core {\n  public static class Help {\n    public static int Twice(this User u) { return 2; }\n  }\n}\n",
    "App/Web/Svc.cs": (
        "using App.Core;\nusing App.Core.Help;\nusing M = App.Core.Mail;\nnamespace App.Web {\n  public class Svc : Base {\n    public void Run() {\n      var u = new User();\n      u.Name();\n      u.Box.Send();\n"
        "      base.Start();\n      base.Stop();\n      u.Twice();\n      App.Core.Help.Twice(u);\n      M m = Make();\n      m.Send();\n    }\n  }\n}\n"
    ),
    # Rust: modules, re-exports
    "src/lib.rs": "pub mod util;\npub mod api;\n",
    "src/util.rs": "pub mod deep;\npub fn go() {}\n",
    "src/util/deep.rs": "pub fn dig() {}\n",
    "src/api.rs": "pub use crate::util::go;\n",
    "src/user.rs": "use crate::util;\nuse crate::api::go as fetch;\nfn run() {\n    crate::util::go();\n    util::deep::dig();\n    fetch();\n}\n",
    # C: a header behind a header
    "csrc/main.c": '#include "outer.h"\nint main(void) { return inner(); }\n',
    "csrc/outer.h": '#include "inner.h"\n',
    "csrc/inner.h": "int inner(void) { return 1; }\n",
    # TypeScript: namespace and alias re-exports, two hops
    "web/b.ts": "export function deep() { return 1; }\n",
    "web/one.ts": "export { deep as mid } from './b';\n",
    "web/two.ts": "export { mid as top } from './one';\n",
    "web/ns.ts": "export * as box from './b';\n",
    "web/use.ts": "import { top } from './two';\nimport { box } from './ns';\nexport function run() { top(); box.deep(); }\n",
}


def test_calls_resolve_by_language(spark, tmp_path):
    write(str(tmp_path), RESOLUTION)
    built = index.index_tree(spark, str(tmp_path))
    got = {(r["file"], r["callee"]): (r["callee_file"], r["confidence"]) for r in built.calls.collect()}
    want = {
        ("src/a/b/Use.java", "Tool.go"): "src/a/b/Tool.java",
        ("src/c/Other.java", "Tool.go"): "src/a/b/Tool.java",
        ("App/Web/Svc.cs", "u.Name"): "App/Core/User.cs",
        ("App/Web/Svc.cs", "u.Box.Send"): "App/Core/Mail.cs",
        ("App/Web/Svc.cs", "base.Start"): "App/Core/Base.cs",
        ("App/Web/Svc.cs", "base.Stop"): "App/Core/Root.cs",
        ("App/Web/Svc.cs", "u.Twice"): "App/Core/Help.cs",
        ("App/Web/Svc.cs", "App.Core.Help.Twice"): "App/Core/Help.cs",
        ("App/Web/Svc.cs", "m.Send"): "App/Core/Mail.cs",
        ("src/user.rs", "crate.util.go"): "src/util.rs",
        ("src/user.rs", "util.deep.dig"): "src/util/deep.rs",
        ("src/user.rs", "fetch"): "src/util.rs",
        ("csrc/main.c", "inner"): "csrc/inner.h",
        ("web/use.ts", "top"): "web/b.ts",
        ("web/use.ts", "box.deep"): "web/b.ts",
    }
    assert {k: got[k][0] for k in want} == want
    assert got["csrc/main.c", "inner"][1] == 0.68 and got["src/user.rs", "crate.util.go"][1] == 0.76 and got["src/user.rs", "util.deep.dig"][1] == 0.74


def test_context_ranges(project):
    project._vectors = project._chunks = None
    pack = project.context_pack("look at it", seed_files=["app/auth.py#L7-L8"], seed_symbols=["load"])
    ranges = rows(pack["ranges"], "file", "start_line", "end_line")
    assert ranges == sorted(ranges) and ("app/auth.py", 8) in {(f, e) for f, _, e in ranges}
    by = {}
    for f, a, z in ranges:
        assert a <= z and all(a > y for _, y in by.get(f, [])), "no line twice"
        by.setdefault(f, []).append((a, z))
    sources = {x for r in pack["ranges"].collect() for x in r["sources"]}
    assert {"task_location", "symbol_definition", "call_graph", "dependency"} <= sources
    assert pack["locations"].first()["locations"]["app/store.py"] == ["1-2"]
    assert pack["read_less"].first()["selected"] == sum(z - a + 1 for f, a, z in ranges)


def test_first_read(project, tmp_path):
    import sys

    answer = json.dumps({"result": {"provider": "p", "results": [{"path": "main.py"}], "semantic_results": [{"file": "./app/auth.py", "score": 1.0}, {"file": "gone.py"}]}})
    got = project.agent_first_read("fix the login in app/auth.py", backend_json=answer)
    assert got["first_file"] == "app/auth.py" and got["agreement"] == "agree" and got["next"] == "read_ranges"
    assert [c["file"] for c in got["backend"]["candidates"]] == ["app/auth.py", "gone.py", "main.py"] and got["backend"]["freshness"] == "non_git"
    said = project.agent_first_read("fix the login", backend_command=[sys.executable, "-c", "import json, sys; print(json.dumps([sys.argv[1] + '.py']))"])
    assert [c["file"] for c in said["backend"]["candidates"]] == ["authentication.py"]
    assert project.agent_first_read("fix the login in app/auth.py")["backend"] is None
    with pytest.raises(ValueError):
        project.agent_first_read("x", backend_json="[]", backend_file="f")


def test_backend_states():
    from codeloom.sources.backend import freshness as state

    assert [state("a", "a"), state("a", "b"), state(None), state("a", forced=True), state("a", indexed=False), state("a", lost=1), state("a")] == ["cached", "changed", "non_git", "forced", "missing", "stale_candidates", "unverified"]
    assert [state("a", head="h", indexed_head="h", dirty=True), state("a", head="h", indexed_head="h"), state("a", head="h", indexed_head="i")] == ["dirty", "head_match", "stale"]


def test_backend_evidence_is_cut():
    from codeloom.sources import backend

    many = backend.normalise([f"f{i}.py" for i in range(20)] + ["f0.py", 3, {"x": 1}])
    assert (len(many.candidates), many.total, many.omitted) == (16, 20, 4)
    assert backend.evidence() is None and backend.normalise("x").candidates == []
    with pytest.raises(ValueError):
        backend.evidence(text="{")


def test_impact_paths_and_summary(project):
    got = project.impact_analysis(files=["app/store.py"], depth=2, format="summary", evidence_limit=1)
    assert got["files"].count() == 1 and got["counts"].first()["files"] > 1 and got["evidence"].count() == 1
    paths = rows(project.impact_paths(["app/store.py"], 2), "kind", "depth", "from", "to", "line")
    assert ("importer", 1, "app/store.py", "app/auth.py", 1) in paths and any(p[1] == 2 for p in paths)
    assert {r["topic"] for r in got["review"].collect()} >= {"risk", "depth", "top_file"}
    with pytest.raises(ValueError):
        project.impact_analysis(files=["x"], format="other")


def test_ignored_files_are_nowhere(spark, tmp_path):
    write(str(tmp_path), {
        ".gitignore": "# note\ngen/\n*.tmp.py\n!keep.tmp.py\n/only_root.py\n", "a.py": "def find_me():\n    pass\n", "gen/b.py": "find_me()\n", "x.tmp.py": "find_me()\n", "keep.tmp.py": "find_me()\n",
        "sub/.gitignore": "local.py\n!inner.py\n", "sub/local.py": "find_me()\n", "sub/inner.py": "find_me()\n", "sub/only_root.py": "find_me()\n", "only_root.py": "find_me()\n", "other/local.py": "find_me()\n",
    })
    p = Project(spark, str(tmp_path))
    kept = {"a.py", "keep.tmp.py", "sub/inner.py", "sub/only_root.py", "other/local.py"}
    p.index_project()
    assert {r[0] for r in rows(p.tables.files, "path")} == kept
    assert {r[0] for r in rows(p.find_references("find_me", include_definitions=True), "path")} == kept
    p.semantic_index(5)
    assert {r[0] for r in rows(p._chunks, "file")} == kept


def test_store_is_opened_again(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "tree"), str(tmp_path / "store")
    write(root, {"a.py": "def f():\n    g()\n", "b.py": "def g():\n    pass\n"})
    first = Project(spark, root, store)
    assert first.index_project().first()["files"] == 2
    parsed = []
    real = index.extract_files
    monkeypatch.setattr(index, "extract_files", lambda df: parsed.append(df.count()) or real(df))
    again = Project(spark, root, store)
    row = again.index_project().first()
    assert row["files"] == 2 and parsed == [] and row["duration_ms"] > 0
    write(root, {"a.py": "def f():\n    h()\n"})
    assert Project(spark, root, store).index_project().first()["calls"] == 1 and parsed == [1]
    from codeloom.sources import records

    monkeypatch.setattr(records, "SCHEMA_VERSION", "other")
    assert index.open_index(spark, store) is None


def test_changes_are_explained(spark, tmp_path):
    write(str(tmp_path), {"a.py": "x = 1\n"})
    p = Project(spark, str(tmp_path))
    got = p.semantic_index(5, explain=True)
    assert rows(got["changes"], "file", "change") == [("a.py", "added")] and got["counts"].first()["generated"] == 1
    write(str(tmp_path), {"a.py": "x = 2\n"})
    p.index_project()
    assert rows(p.semantic_index(5, explain=True)["changes"], "file", "change") == [("a.py", "updated")]
    with pytest.raises(ValueError):
        p.semantic_index(5, provider="nope")


def test_provider_of_the_environment(spark, tmp_path, monkeypatch):
    write(str(tmp_path), {"a.py": "x = 1\n"})
    p = Project(spark, str(tmp_path))
    assert p.semantic_index(5, provider="env").first()["vector_status"] == "provider_not_configured"
    assert p.embedding_status("env").first()["status"] == "disabled"
    monkeypatch.setenv("CODELOOM_EMBEDDINGS", "local-hash")
    assert p.semantic_index(5, provider="env").first()["generated"] == 1
    assert p.embedding_status("env").first()["status"] == "complete"


def test_long_answers_say_what_is_left_out(spark, monkeypatch):
    from codeloom import cli

    monkeypatch.setattr(cli, "MOST_ROWS", 3)
    assert cli.plain(spark.range(5))["omitted"] == 2 and len(cli.plain(spark.range(3))) == 3
