"""Cases of call resolution, one for each arm: files with their symbols, edges, calls and where those lead.

``{k}`` stands for a supplier's key and ``{ns}`` for the folder of the case and the key as
a namespace; every case lies in a folder of its own name. Edges
are source, kind, target, resolved file, alias, imported name and line; calls are source,
caller, callee, line, and by hand the file and the confidence to be found.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Case:
    name: str
    language: str
    files: dict[str, list[tuple[str, str, str, int]]]
    edges: list[tuple[str, str, str, str | None, str | None, str | None, int]]
    calls: list[tuple[str, str, str, int, str | None, float]]


def _f(*names: str) -> list[tuple[str, str, str, int]]:
    """Functions, named by their qualified names, one a line."""
    return [(n.rpartition(".")[2], n, "function", i + 1) for i, n in enumerate(names)]


OPEN = 0.55
CASES: dict[str, list[Case]] = {}

CASES["script"] = [
    Case(
        "direct", "typescript", {"a.ts": _f("start"), "b.ts": _f("go", "Deep.inner", "own"), "c.ts": _f("go")},
        [("a.ts", "import", "./b", "b.ts", None, None, 1), ("a.ts", "import_alias", "./b", "b.ts", "run", "go", 1), ("a.ts", "import_namespace", "./b", "b.ts", "ns", "*", 2), ("a.ts", "require", "./c", "c.ts", None, None, 9)],
        [("a.ts", "start", "run", 3, "b.ts", 0.72), ("a.ts", "start", "ns.own", 4, "b.ts", 0.72), ("a.ts", "start", "inner", 5, "b.ts", 0.72), ("a.ts", "start", "require.go", 9, "c.ts", 0.72),
         ("a.ts", "start", "require.go", 10, None, OPEN), ("a.ts", "start", "missing{k}", 6, None, OPEN)],
    ),
    Case(
        "alias_one", "typescript", {"a.ts": [], "barrel.ts": [], "b.ts": _f("go{k}")},
        [("a.ts", "import_alias", "./barrel", "barrel.ts", "run", "shown", 1), ("barrel.ts", "export_alias", "./b", "b.ts", "shown", "go{k}", 1)],
        [("a.ts", "f", "run", 2, "b.ts", 0.72)],
    ),
    Case(
        "namespace_one", "typescript", {"a.ts": [], "barrel.ts": [], "b.ts": _f("go{k}")},
        [("a.ts", "import_alias", "./barrel", "barrel.ts", "go{k}", "go{k}", 1), ("barrel.ts", "export_namespace", "./b", "b.ts", None, "*", 1)],
        [("a.ts", "f", "go{k}", 2, "b.ts", 0.72), ("a.ts", "f", "other", 3, None, OPEN)],
    ),
    Case(
        "alias_two", "javascript", {"a.js": [], "one.js": [], "two.js": [], "b.js": _f("last")},
        [("a.js", "import_alias", "./one", "one.js", "x", "first", 1), ("one.js", "export_alias", "./two", "two.js", "first", "second{k}", 1), ("two.js", "export_alias", "./b", "b.js", "second{k}", "last", 1)],
        [("a.js", "f", "x", 2, "b.js", 0.72)],
    ),
    Case(
        "alias_namespace", "javascript", {"a.js": [], "one.js": [], "two.js": [], "b.js": _f("last{k}")},
        [("a.js", "import_alias", "./one", "one.js", "x", "tools", 1), ("one.js", "export_alias", "./two", "two.js", "tools", "box", 1), ("two.js", "export_namespace", "./b", "b.js", "box", "*", 1)],
        [("a.js", "f", "x.last{k}", 2, "b.js", 0.72)],
    ),
    Case(
        "order", "typescript", {"a.ts": [], "far.ts": _f("Long.Nested.go"), "near.ts": _f("go")},
        [("a.ts", "import", "./far", "far.ts", None, None, 1), ("a.ts", "import", "./near", "near.ts", None, None, 2)],
        [("a.ts", "f", "go", 3, "near.ts", 0.72)],
    ),
]

CASES["java"] = [
    Case(
        "wildcard", "java", {"src/a/Main.java": [], "src/b/tools/Tool.java": _f("Tool.go"), "src/c/Tool.java": _f("Tool.go")},
        [("src/a/Main.java", "import", "{ns}.src.b.tools.*", None, None, None, 2), ("src/a/Main.java", "package", "{ns}.src.a", None, None, None, 1)],
        [("src/a/Main.java", "Main.run", "Tool.go", 5, "src/b/tools/Tool.java", 0.72), ("src/a/Main.java", "Main.run", "Other.go", 6, None, OPEN)],
    ),
    Case(
        "package", "java", {"src/a/b/Main.java": [], "src/a/b/Near{k}.java": _f("Near{k}.go")},
        [("src/a/b/Main.java", "package", "{ns}.src.a.b", None, None, None, 1)],
        [("src/a/b/Main.java", "Main.run", "Near{k}.go", 5, "src/a/b/Near{k}.java", 0.72)],
    ),
]

_CS = [("Main.cs", "using", "{ns}.Lib", None, None, None, 1), ("Main.cs", "namespace", "{ns}.App", None, None, None, 2)]
CASES["csharp"] = [
    Case("full_static", "csharp", {"Main.cs": [], "Lib/Core/Tool{k}.cs": _f("Tool{k}.Go")}, [], [("Main.cs", "Main.Run", "{ns}.Lib.Core.Tool{k}.Go", 5, "Lib/Core/Tool{k}.cs", 0.72)]),
    Case("same_namespace", "csharp", {"App/Main.cs": [], "App/Near.cs": _f("Near.Go{k}")}, [("App/Main.cs", "namespace", "{ns}.App", None, None, None, 1)], [("App/Main.cs", "Main.Run", "Near.Go{k}", 5, "App/Near.cs", 0.72)]),
    Case("base_scoped", "csharp", {"Main.cs": [], "Lib/Root.cs": _f("Root.Up{k}")}, [*_CS, ("Main.cs", "base_type", "Root", None, None, "Main", 3)], [("Main.cs", "Main.Run", "base.Up{k}", 5, "Lib/Root.cs", 0.72)]),
    Case("base_qualified", "csharp", {"Main.cs": [], "Deep/Lib/Root.cs": _f("Root.Up")}, [("Main.cs", "base_type", "{ns}.Deep.Lib.Root", None, None, "Main", 3)], [("Main.cs", "Main.Run", "base.Up", 5, "Deep/Lib/Root.cs", 0.72)]),
    Case(
        "grand_qualified", "csharp", {"Main.cs": [], "Deep/Mid.cs": _f("Mid.Other"), "Lib/Root.cs": _f("Root.Up{k}")},
        [("Main.cs", "base_type", "{ns}.Deep.Mid", None, None, "Main", 3), ("Deep/Mid.cs", "base_type", "Root", None, None, "Mid", 2), ("Deep/Mid.cs", "using", "{ns}.Lib", None, None, None, 1)],
        [("Main.cs", "Main.Run", "base.Up{k}", 5, "Lib/Root.cs", 0.72)],
    ),
    Case(
        "grand_scoped", "csharp", {"Main.cs": [], "Lib/Mid.cs": _f("Mid.Other"), "Far/Root.cs": _f("Root.Up{k}")},
        [*_CS, ("Main.cs", "base_type", "Mid", None, None, "Main", 3), ("Lib/Mid.cs", "base_type", "Root", None, None, "Mid", 2), ("Lib/Mid.cs", "using", "{ns}.Far", None, None, None, 1)],
        [("Main.cs", "Main.Run", "base.Up{k}", 5, "Far/Root.cs", 0.72)],
    ),
    Case(
        "chain_scoped", "csharp", {"Main.cs": [], "Hub{k}.cs": [], "Lib/Store.cs": _f("Store.Get")},
        [("Hub{k}.cs", "property_type", "Store", None, "Data", "Hub{k}", 4), ("Hub{k}.cs", "using", "{ns}.Lib", None, None, None, 1)],
        [("Main.cs", "Main.Run", "Hub{k}.Data.Get", 5, "Lib/Store.cs", 0.72)],
    ),
    Case(
        "chain_qualified", "csharp", {"Main.cs": [], "Hub.cs": [], "Lib/Deep/Store.cs": _f("Store.Get")},
        [("Hub.cs", "property_type", "{ns}.Lib.Deep.Store", None, "Data", "Hubq{k}", 4)],
        [("Main.cs", "Main.Run", "Hubq{k}.Data.Get", 5, "Lib/Deep/Store.cs", 0.72)],
    ),
    Case("local_scoped", "csharp", {"Main.cs": [], "Lib/User.cs": _f("User.Name{k}")}, [*_CS, ("Main.cs", "type_binding", "User", None, "u", "*", 4)], [("Main.cs", "Main.Run", "u.Name{k}", 5, "Lib/User.cs", 0.72)]),
    Case(
        "local_property", "csharp", {"Main.cs": [], "Lib/User.cs": _f("Role.Level")},
        [*_CS, ("Main.cs", "type_binding", "User", None, "u", "*", 4), ("Lib/User.cs", "property_type", "Role", None, "Role{k}", "User", 3)],
        [("Main.cs", "Main.Run", "u.Role{k}.Level", 5, "Lib/User.cs", 0.72)],
    ),
    Case(
        "property_scoped", "csharp", {"Main.cs": [], "Lib/User.cs": [], "Far/Role.cs": _f("Role.Level")},
        [*_CS, ("Main.cs", "type_binding", "User", None, "u", "*", 4), ("Lib/User.cs", "property_type", "Role", None, "Own{k}", "User", 3), ("Lib/User.cs", "using", "{ns}.Far", None, None, None, 1)],
        [("Main.cs", "Main.Run", "u.Own{k}.Level", 5, "Far/Role.cs", 0.72)],
    ),
    Case(
        "property_qualified", "csharp", {"Main.cs": [], "Lib/User.cs": [], "Far/Deep/Role.cs": _f("Role.Level")},
        [*_CS, ("Main.cs", "type_binding", "User", None, "u", "*", 4), ("Lib/User.cs", "property_type", "{ns}.Far.Deep.Role", None, "Own{k}", "User", 3)],
        [("Main.cs", "Main.Run", "u.Own{k}.Level", 5, "Far/Deep/Role.cs", 0.72)],
    ),
    Case("local_qualified", "csharp", {"Main.cs": [], "Lib/Deep/User.cs": _f("User.Name")}, [("Main.cs", "type_binding", "{ns}.Lib.Deep.User", None, "u{k}", "*", 4)], [("Main.cs", "Main.Run", "u{k}.Name", 5, "Lib/Deep/User.cs", 0.72)]),
    Case(
        "local_alias", "csharp", {"Main.cs": [], "Lib/Deep/User.cs": _f("User.Name")},
        [("Main.cs", "using_alias", "{ns}.Lib.Deep.User", None, "Person{k}", None, 1), ("Main.cs", "type_binding", "Person{k}", None, "p", "*", 4)],
        [("Main.cs", "Main.Run", "p.Name", 5, "Lib/Deep/User.cs", 0.72)],
    ),
    Case(
        "extension", "csharp", {"Main.cs": [], "Lib/Ext.cs": _f("Ext.Twice{k}")},
        [("Main.cs", "using", "{ns}.Lib", "Lib/Ext.cs", None, None, 1), ("Main.cs", "type_binding", "User", None, "u", "*", 4), ("Lib/Ext.cs", "extension_method", "User", None, "Twice{k}", "Twice{k}", 3)],
        [("Main.cs", "Main.Run", "u.Twice{k}", 5, "Lib/Ext.cs", 0.72)],
    ),
    Case(
        "extension_suffix", "csharp", {"Main.cs": [], "Lib/Ext.cs": _f("Ext.Twice{k}")},
        [("Main.cs", "using", "{ns}.Lib", "Lib/Ext.cs", None, None, 1), ("Lib/Ext.cs", "extension_method", "User", None, "Twice{k}", "Twice{k}", 3)],
        [("Main.cs", "Main.Run", "this.User.Twice{k}", 5, "Lib/Ext.cs", 0.72)],
    ),
    Case(
        "wrapper", "csharp", {"Main.cs": [], "Lib/User.cs": _f("User.Name")},
        [*_CS, ("Main.cs", "type_binding", "User", None, "box{k}", "Value", 4)],
        [("Main.cs", "Main.Run", "box{k}.Value.Name", 5, "Lib/User.cs", 0.72), ("Main.cs", "Main.Run", "nobody{k}.Name", 6, None, OPEN)],
    ),
]

CASES["rust"] = [
    Case(
        "reexport_one", "rust", {"src/a.rs": [], "src/pre.rs": [], "src/b.rs": _f("go")},
        [("src/a.rs", "use", "crate::pre::run", "src/pre.rs", "run", "run", 1), ("src/pre.rs", "rust_reexport", "crate::b::go", "src/b.rs", "run", "go", 1)],
        [("src/a.rs", "f", "run", 2, "src/b.rs", 0.72)],
    ),
    Case(
        "reexport_two", "rust", {"src/a.rs": [], "src/pre.rs": [], "src/mid.rs": [], "src/b.rs": _f("last{k}")},
        [("src/a.rs", "use", "crate::pre::run", "src/pre.rs", "run", "run", 1), ("src/pre.rs", "rust_reexport", "crate::mid::go", "src/mid.rs", "run", "go", 1), ("src/mid.rs", "rust_reexport", "crate::b::last{k}", "src/b.rs", "go", "last{k}", 1)],
        [("src/a.rs", "f", "run", 2, "src/b.rs", 0.72)],
    ),
    Case(
        "glob_one", "rust", {"src/a.rs": [], "src/pre.rs": [], "src/b.rs": _f("go{k}")},
        [("src/a.rs", "use", "crate::pre::go{k}", "src/pre.rs", "go{k}", "go{k}", 1), ("src/pre.rs", "rust_reexport", "crate::b", "src/b.rs", None, "*", 1)],
        [("src/a.rs", "f", "go{k}", 2, "src/b.rs", 0.72)],
    ),
    Case(
        "glob_twins", "rust", {"src/a.rs": [], "src/pre.rs": [], "src/b.rs": _f("go"), "src/c.rs": _f("go")},
        [("src/a.rs", "use", "crate::pre::go", "src/pre.rs", "go", "go", 1), ("src/pre.rs", "rust_reexport", "crate::b", "src/b.rs", None, "*", 1), ("src/pre.rs", "rust_reexport", "crate::c", "src/c.rs", None, "*", 2)],
        [("src/a.rs", "f", "go", 2, None, OPEN)],
    ),
    Case(
        "glob_two", "rust", {"src/a.rs": [], "src/pre.rs": [], "src/mid.rs": [], "src/b.rs": _f("go{k}")},
        [("src/a.rs", "use", "crate::pre::run", "src/pre.rs", "run", "run", 1), ("src/pre.rs", "rust_reexport", "crate::mid::go{k}", "src/mid.rs", "run", "go{k}", 1), ("src/mid.rs", "rust_reexport", "crate::b", "src/b.rs", None, "*", 1)],
        [("src/a.rs", "f", "run", 2, "src/b.rs", 0.72)],
    ),
    Case("crate", "rust", {"src/a.rs": _f("here"), "src/net.rs": _f("open{k}"), "src/net/wire.rs": _f("send")}, [], [("src/a.rs", "f", "crate.net.open{k}", 2, "src/net.rs", 0.76), ("src/net.rs", "f", "self.wire.send", 3, "src/net/wire.rs", 0.76)]),
    Case(
        "module", "rust", {"src/a.rs": [], "src/net.rs": [], "src/net/wire.rs": _f("send{k}")},
        [("src/a.rs", "use", "crate::net", "src/net.rs", "net", "net", 1)],
        [("src/a.rs", "f", "net.wire.send{k}", 2, "src/net/wire.rs", 0.74)],
    ),
    Case(
        "star", "rust", {"src/a.rs": [], "src/b.rs": _f("go{k}", "Type.method")},
        [("src/a.rs", "use", "crate::b", "src/b.rs", None, "*", 1)],
        [("src/a.rs", "f", "go{k}", 2, "src/b.rs", 0.72), ("src/a.rs", "f", "nothing", 3, None, OPEN)],
    ),
]

CASES["go"] = [
    Case(
        "package", "go", {"cmd/main.go": [], "tool/a.go": _f("Do{k}"), "tool/b.go": _f("Other")},
        [("cmd/main.go", "import", "x.org/tool", "tool/a.go", "tool", None, 2)],
        [("cmd/main.go", "main", "tool.Do{k}", 5, "tool/a.go", 0.72), ("cmd/main.go", "main", "tool.Other", 6, "tool/b.go", 0.72), ("cmd/main.go", "main", "tool.None", 7, None, OPEN)],
    ),
    Case(
        "twice", "go", {"cmd/main.go": [], "tool/a.go": _f("First"), "tool/b.go": _f("Do"), "tool/c.go": _f("Do")},
        [("cmd/main.go", "import", "x.org/tool", "tool/a.go", "tool", None, 2)],
        [("cmd/main.go", "main", "tool.Do", 5, None, OPEN)],
    ),
    Case(
        "dot", "go", {"cmd/main.go": [], "tool/a.go": _f("Do{k}")},
        [("cmd/main.go", "import", "x.org/tool", "tool/a.go", ".", None, 2)],
        [("cmd/main.go", "main", "Do{k}", 5, "tool/a.go", 0.72)],
    ),
    Case(
        "blank", "go", {"cmd/main.go": [], "tool/a.go": _f("Do")},
        [("cmd/main.go", "import", "x.org/tool", "tool/a.go", "_", None, 2)],
        [("cmd/main.go", "main", "_.Do", 5, None, OPEN)],
    ),
]

CASES["c"] = [
    Case("include", "c", {"main.c": [], "one{k}.h": _f("twice")}, [("main.c", "include", "one{k}.h", "one{k}.h", None, None, 1)], [("main.c", "main", "twice", 3, "one{k}.h", 0.72)]),
    Case(
        "ambiguous", "c", {"main.c": [], "one.h": _f("twice"), "two.h": _f("twice")},
        [("main.c", "include", "one.h", "one.h", None, None, 1), ("main.c", "include", "two.h", "two.h", None, None, 2)],
        [("main.c", "main", "twice", 3, None, OPEN)],
    ),
    Case(
        "closure", "cpp", {"main.cpp": [], "one.h": [], "two.h": [], "deep{k}.h": _f("far{k}")},
        [("main.cpp", "include", "one.h", "one.h", None, None, 1), ("one.h", "include", "two.h", "two.h", None, None, 1), ("two.h", "include", "deep{k}.h", "deep{k}.h", None, None, 1), ("deep{k}.h", "include", "one.h", "one.h", None, None, 2)],
        [("main.cpp", "main", "far{k}", 3, "deep{k}.h", 0.68)],
    ),
]
