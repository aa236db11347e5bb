"""Command line and line-wise JSON-RPC over the tools of a project.

    python -m codeloom.cli ROOT TOOL ['{"argument": value}'] [--compact]
    python -m codeloom.cli ROOT config_init ['{"force": true}']
    python -m codeloom.cli ROOT serve
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession

from codeloom.api import TOOLS, Project

#: Rows of a table that an answer carries; the answer says how many more there are.
MOST_ROWS = 10_000
#: What the command line can do beyond the tools.
COMMANDS = ("config_init", "file_metadata", "recommended_next_tools", "overview_text")


def plain(value: object) -> object:
    """Values of an answer as JSON can carry them; tables become lists of rows, longer ones with the number that is left out."""
    if isinstance(value, DataFrame):
        rows = [json.loads(r) for r in value.limit(MOST_ROWS + 1).toJSON().collect()]
        return rows if len(rows) <= MOST_ROWS else {"rows": rows[:MOST_ROWS], "omitted": value.count() - MOST_ROWS}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def answer(project: Project, request: dict, names: tuple[str, ...] = TOOLS) -> dict:
    """One JSON-RPC answer; unknown tools and bad arguments are errors, not crashes."""
    head = {"jsonrpc": "2.0", "id": request.get("id")}
    method, params = request.get("method"), request.get("params") or {}
    if method == "tools/list":
        return head | {"result": {"tools": [{"name": t} for t in TOOLS]}}
    name, arguments = (params.get("name"), params.get("arguments") or {}) if method == "tools/call" else (method, params)
    if name not in names:
        return head | {"error": {"code": -32601, "message": f"unknown tool {name!r}"}}
    try:
        return head | {"result": plain(getattr(project, name)(**arguments))}
    except (TypeError, ValueError, FileExistsError) as e:
        return head | {"error": {"code": -32602, "message": str(e)}}


def serve(project: Project, lines, out) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(project, json.loads(line))
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        out.write(json.dumps(reply) + "\n")
        out.flush()


def main(args: list[str]) -> int:
    compact = "--compact" in args
    args = [a for a in args if a != "--compact"]
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("codeloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    project = Project(spark, args[0])
    if args[1] == "serve":
        serve(project, sys.stdin, sys.stdout)
        return 0
    reply = answer(project, {"id": 1, "method": args[1], "params": json.loads(args[2]) if len(args) > 2 else {}}, TOOLS + COMMANDS)
    print(json.dumps(reply.get("result", reply), indent=None if compact else 2))
    return int("error" in reply)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
