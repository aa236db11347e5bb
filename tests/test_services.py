from __future__ import annotations

import http.server
import json
import sys
import threading

import pytest

from codeloom.operators import semantic
from codeloom.sources import services


@pytest.fixture()
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            rows = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(asked["input"])]
            body = json.dumps({"data": rows[::-1]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/embed"
    s.shutdown()


def test_http_provider(spark, server, monkeypatch):
    monkeypatch.setitem(semantic.PROVIDERS, "http", ("m", services.HttpEmbeddings(server, "m")))
    chunks = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, text string")
    rows = semantic.embed(chunks, ["id"], "http", batch=2).collect()
    assert {(r["id"], r["vector"][0]) for r in rows} == {(i, float(i)) for i in range(5)} and {r["dimensions"] for r in rows} == {2}


def test_answers_are_checked():
    row = lambda i, v: {"index": i, "embedding": v}
    assert [v.tolist() for v in services.vectors_of({"embeddings": [[1], [2]]}, 2)] == [[1.0], [2.0]]
    for bad in ({"data": [row(0, [1]), row(0, [2])]}, {"data": [row(0, [1])]}, {"embeddings": [[1]]}, {"embeddings": [[1], [1, 2]]}, {}):
        with pytest.raises(ValueError):
            services.vectors_of(bad, 2)


def test_provider_settings():
    assert services.provider_from_env({}) is None
    assert services.provider_from_env({"CODELOOM_EMBEDDINGS": "local-hash"})[1] == "sha256-64"
    assert services.provider_from_env({"CODELOOM_EMBEDDINGS": "http", "CODELOOM_EMBEDDINGS_URL": "http://x", "CODELOOM_EMBEDDINGS_MODEL": "m"})[2].model == "m"
    for bad in ({"CODELOOM_EMBEDDINGS": "nope"}, {"CODELOOM_EMBEDDINGS": "http", "CODELOOM_EMBEDDINGS_URL": "ftp://x", "CODELOOM_EMBEDDINGS_MODEL": "m"}, {"CODELOOM_EMBEDDINGS": "http", "CODELOOM_EMBEDDINGS_URL": "http://x"}):
        with pytest.raises(ValueError):
            services.provider_from_env(bad)
    assert services.batch_size({}) == 64 and services.batch_size({"CODELOOM_EMBEDDINGS_BATCH": "8"}) == 8
    with pytest.raises(ValueError):
        services.batch_size({"CODELOOM_EMBEDDINGS_BATCH": "0"})


def test_commands():
    run = lambda code, deadline=30.0: services.command_json([sys.executable, "-c", code], deadline)
    assert run("print('{\"result\": {\"content\": [{\"text\": \"[1, 2]\"}]}}')") == [1, 2]
    for code, deadline in (("import time; time.sleep(9)", 0.3), ("raise SystemExit(3)", 30), ("print('x')", 30)):
        with pytest.raises(ValueError):
            run(code, deadline)


def test_search_pattern():
    assert services.search_pattern(["login", "userName", "a_b", "c_d"]) == "c_d"
    assert services.search_pattern(["login", "User", "names"]) == "User"
    assert services.search_pattern([]) is None


def test_expectations_as_json(spark, tmp_path):
    from codeloom.sources import records

    path = tmp_path / "e.json"
    path.write_text('[{"task": "find it", "first_file": "a.py", "strategy": "explicit"}, {"task": " ", "first_file": "b.py"}, {"first_file": "c.py"}]')
    rows = records.read_json_expectations(spark, str(path)).collect()
    assert [(r["task"], r["first_file"], r["strategy"], r["seed"]) for r in rows] == [("find it", "a.py", "explicit", None)]


def test_manifest_of_another_version(spark, tmp_path, monkeypatch):
    from codeloom.sources import records

    assert records.read_manifest(spark, str(tmp_path)) is None
    records.write_manifest(spark, str(tmp_path), {"a": "1"})
    assert records.read_manifest(spark, str(tmp_path)) == {"a": "1", "schema_version": records.SCHEMA_VERSION}
    monkeypatch.setattr(records, "SCHEMA_VERSION", "0")
    assert records.read_manifest(spark, str(tmp_path)) is None


def test_commands_beyond_the_tools(spark, tmp_path):
    from codeloom import cli
    from codeloom.api import Project

    p = Project(spark, str(tmp_path))
    ask = lambda name, **a: cli.answer(p, {"id": 1, "method": name, "params": a}, cli.TOOLS + cli.COMMANDS)
    assert ask("config_init")["result"].endswith("codeloom.toml") and ask("config_init")["error"]["code"] == -32602
    assert ask("config_init", force=True)["result"] and "0 indexed files" in ask("overview_text")["result"]
    assert cli.answer(p, {"id": 1, "method": "config_init"})["error"]["code"] == -32601
