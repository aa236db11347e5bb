from __future__ import annotations

import pytest

from codeloom.parse import paths
from codeloom.parse.extract import dependencies, element_type, extract, php_uses, rust_use_tree
from codeloom.parse.lexer import dotted, mask, split_top, string_value, strip_generics


def names(text, language):
    return {(s.qualified_name, s.kind) for s in extract(text, language).symbols}


def edges(text, language):
    return {(d.kind, d.target, d.local_alias, d.imported_symbol) for d in extract(text, language).dependencies}


def calls(text, language):
    return {(c.caller, c.callee) for c in extract(text, language).calls}


PYTHON = """import os
import json as j
from .util import helper, other as o
from pkg.mod import *

class Base: pass

class Service(Base):
    @property
    def name(self):
        return helper(self.x)

    async def login(self):
        def inner():
            return o.run()[0].go()
        return inner()

CONST = os.getcwd()
"""


def test_python():
    assert names(PYTHON, "python") == {
        ("Base", "class"), ("Service", "class"), ("Service.name", "method"), ("Service.login", "method"), ("Service.inner", "function"),
    }
    assert edges(PYTHON, "python") >= {
        ("import", "os", "os", "*"), ("import", "json", "j", "*"), ("import", ".util", None, None), ("import", ".util.helper", "helper", "helper"),
        ("import", ".util.other", "o", "other"), ("import", "pkg.mod", None, None), ("base_type", "Base", None, "Service"),
    }
    assert calls(PYTHON, "python") >= {("Service.name", "helper"), ("Service.inner", "o.run.go"), ("Service.login", "inner"), ("<module>", "os.getcwd")}
    assert extract(PYTHON, "python").symbols[2].start_line == 9
    with pytest.raises(SyntaxError):
        extract("def (", "python")


TS = """import def, { a as b, type T } from './mod';
import * as ns from "pkg";
export { x as y } from '../re';
export * from './all';
const dir = './d' + '/e';
const lazy = require(dir);
const { p, q: r } = require(`${dir}/f`);
// import no from 'no';
export interface Repo extends Other<User, Role> {}
export class Auth extends Base implements Repo {
  async login(user: User): Promise<void> {
    if (user) { helper(user); }
    this.repo?.find<User>(1);
  }
}
export function helper(u: User) { return ns.go(u); }
const arrow = (a: number) => { return b(a); };
export default function () { return 1 }
"""


@pytest.mark.parametrize("language", ["typescript", "tsx", "javascript"])
def test_typescript(language):
    assert names(TS, language) >= {("Repo", "interface"), ("Auth", "class"), ("Auth.login", "method"), ("helper", "function"), ("arrow", "function"), ("default", "function")}
    assert edges(TS, language) >= {
        ("import", "./mod", None, None), ("import_alias", "./mod", "def", "default"), ("import_alias", "./mod", "b", "a"), ("import_alias", "./mod", "T", "T"),
        ("import_namespace", "pkg", "ns", "*"), ("export_alias", "../re", "y", "x"), ("export_namespace", "./all", None, "*"),
        ("require", "./d/e", None, None), ("import_namespace", "./d/e", "lazy", "*"), ("import_alias", "./d/e/f", "r", "q"),
        ("base_type", "Other", None, "Repo"), ("base_type", "Base", None, "Auth"), ("base_type", "Repo", None, "Auth"),
    }
    assert not any(t == "no" for _, t, _, _ in edges(TS, language))
    assert calls(TS, language) >= {("Auth.login", "helper"), ("Auth.login", "this.repo.find"), ("helper", "ns.go"), ("arrow", "b")}


CASES = {
    "bash": (
        "source ./lib.sh\n. \"$X/no.sh\"\nbuild() {\n  compile one\n}\nfunction run { build; }\nrun\n",
        {("build", "function"), ("run", "function")}, {("source", "./lib.sh", None, None)}, {("build", "compile"), ("run", "build"), ("<module>", "run")},
    ),
    "c": (
        '#include "audit.h"\n#include <stdio.h>\nstruct point { int x; };\nstatic int add(int a, int b) { return a + b; }\nint main(void) { /* no(1) */ return add(1, 2); }\n',
        {("point", "struct"), ("add", "function"), ("main", "function")}, {("include", "audit.h", None, None), ("include", "<stdio.h>", None, None)}, {("main", "add")},
    ),
    "cpp": (
        "class Shape : public Base {\n public:\n  int area() const { return side(); }\n};\nvoid Shape::draw() { area(); std::sort(a, b); }\n",
        {("Shape", "class"), ("Shape.area", "method"), ("Shape.draw", "method")}, {("base_type", "Base", None, "Shape")}, {("Shape.area", "side"), ("Shape.draw", "area"), ("Shape.draw", "std.sort")},
    ),
    "csharp": (
        "using System;\nusing static App.Tool;\nusing J = App.Json;\nnamespace App.Core {\n  public class Svc : Base<int>, IThing {\n    public List<User> Users { get; set; }\n    public int Run(string s) { var u = new User(); return u.Name(s); }\n  }\n}\n",
        {("Svc", "class"), ("Svc.Run", "method"), ("Svc.Users", "variable")},
        {("using", "System", None, None), ("using_static", "App.Tool", None, None), ("using_alias", "App.Json", "J", None), ("namespace", "App.Core", None, None), ("base_type", "Base", None, "Svc"), ("base_type", "IThing", None, "Svc"), ("property_type", "User", "Users", "Svc"), ("type_binding", "User", "u", "*")},
        {("Svc.Run", "u.Name")},
    ),
    "go": (
        'package main\nimport (\n  "fmt"\n  log "x.org/logging"\n)\ntype Server struct { n int }\nfunc (s *Server) Run(a int) error { return s.stop() }\nfunc main() { fmt.Println("no(1)") }\n',
        {("Server", "struct"), ("Server.Run", "method"), ("main", "function")}, {("package", "main", None, None), ("import", "fmt", "fmt", None), ("import", "x.org/logging", "log", None)}, {("Server.Run", "s.stop"), ("main", "fmt.Println")},
    ),
    "java": (
        "package a.b;\nimport java.util.List;\nimport static a.Tool.go;\npublic class Svc extends Base<X> implements One, Two {\n  private int n;\n  public Svc(int n) { this.n = n; }\n  public int size() { return names.size(); }\n}\n",
        {("Svc", "class"), ("Svc.size", "method"), ("Svc.n", "variable"), ("Svc.Svc", "method")},
        {("package", "a.b", None, None), ("import", "java.util.List", "List", "List"), ("import_static", "a.Tool.go", None, None), ("base_type", "Base", None, "Svc"), ("base_type", "One", None, "Svc"), ("base_type", "Two", None, "Svc")},
        {("Svc.size", "names.size")},
    ),
    "php": (
        "<?php\nnamespace App;\nuse App\\Model\\{User, Role as R};\nclass Svc extends Base {\n  const N = 1;\n  private $x = 2;\n  public function run($a) { return $this->go(Tool::make($a)); }\n}\n",
        {("Svc", "class"), ("Svc.run", "method"), ("Svc.N", "constant"), ("Svc.$x", "variable")},
        {("use", "App\\Model\\User", "User", "User"), ("use", "App\\Model\\Role", "R", "Role"), ("base_type", "Base", None, "Svc"), ("namespace", "App", None, None)},
        {("Svc.run", "this.go"), ("Svc.run", "Tool.make")},
    ),
    "ruby": (
        "require 'json'\nrequire_relative 'lib/my_tool'\nmodule App\n  class Svc < Base\n    LIMIT = 3\n    def run(a)\n      MyTool.go(a)\n    end\n  end\nend\n",
        {("App", "class"), ("App.Svc", "class"), ("App.Svc.run", "method"), ("App.Svc.LIMIT", "constant")},
        {("require", "json", None, None), ("require_relative", "lib/my_tool", "MyTool", "*"), ("base_type", "Base", None, "Svc")},
        {("App.Svc.run", "MyTool.go")},
    ),
    "rust": (
        "mod util;\npub use crate::a::{b::C, d as e};\nuse super::x::*;\nstruct P { x: i32 }\nimpl Show for P { fn show(&self) -> i32 { util::go(self.x) } }\nfn main() { println!(\"{}\", P::new().show()); }\n",
        {("P", "struct"), ("P.show", "method"), ("main", "function")},
        {("mod", "util", "util", "*"), ("rust_reexport", "crate::a::b::C", "C", "C"), ("rust_reexport", "crate::a::d", "e", "d"), ("use", "super::x", None, "*"), ("base_type", "Show", None, "P")},
        {("P.show", "util.go"), ("main", "println")},
    ),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_rules(language):
    text, want_names, want_edges, want_calls = CASES[language]
    assert names(text, language) >= want_names
    assert edges(text, language) >= want_edges
    assert calls(text, language) >= want_calls


def test_mask_keeps_length_and_lines():
    text = 'a("x // y") // c\n/* d\n e */ f(\'z\')'
    got = mask(text, "java")
    assert len(got) == len(text) and got.count("\n") == text.count("\n") and "y" not in got and "d" not in got and "f(" in got


def test_text_helpers():
    assert split_top("a, f(b, c), d<e, f>, g") == ["a", "f(b, c)", "d<e, f>", "g"]
    assert strip_generics("Map<String, List<X>>[]") == "Map"
    assert dotted("a?.b::c->d(x).e<T>") == "a.b.c.d.e"
    assert dotted("a[i].b") == "a.<dynamic>.b"
    assert string_value("'a' + \"b\" + `c${x}`", {"x": "d"}) == "abcd"
    assert string_value("a + 'b'") is None
    assert element_type("Task<List<User>>") == "User" and element_type("Dictionary<int, Role[]>") == "Role"
    assert rust_use_tree("a::{self, b as c, d::{e, f}}") == [("a", None), ("a::b", "c"), ("a::d::e", None), ("a::d::f", None)]
    assert php_uses("function A\\b, C\\d as e") == [("A\\b", None), ("C\\d", "e")]
    assert dependencies("import 'x';\n", "javascript")[0].target == "x"


# --- paths -----------------------------------------------------------------------------


def first(language, source, target, kind="import", known=(), ctx=None):
    return next((c for c in paths.candidates(language, source, target, kind, ctx or paths.Context()) if c in known), None)


@pytest.mark.parametrize(
    "language, source, target, kind, known, want",
    [
        ("python", "a/b/c.py", ".d.e", "import", ["a/b/d.py", "a/b/d/e.py"], "a/b/d/e.py"),
        ("python", "a/b/c.py", "..x", "import", ["a/x/__init__.py"], "a/x/__init__.py"),
        ("python", "a.py", "p.q.name", "import", ["p/q.py"], "p/q.py"),
        ("ruby", "lib/a.rb", "b/c", "require_relative", ["lib/b/c.rb"], "lib/b/c.rb"),
        ("ruby", "lib/a.rb", "My::HTTPClient", "base_type", ["app/my/http_client.rb"], "app/my/http_client.rb"),
        ("rust", "src/lib.rs", "util", "mod", ["src/util/mod.rs"], "src/util/mod.rs"),
        ("rust", "src/a/b.rs", "crate::x::Y", "use", ["src/x.rs"], "src/x.rs"),
        ("rust", "src/a/b.rs", "super::c::D", "use", ["src/a/c.rs"], "src/a/c.rs"),
        ("java", "x/A.java", "a.b.C", "import", ["src/main/java/a/b/C.java"], "src/main/java/a/b/C.java"),
        ("java", "x/A.java", "a.b.C.go", "import_static", ["src/a/b/C.java"], "src/a/b/C.java"),
        ("php", "src/A.php", "App\\Model\\User", "use", ["src/Model/User.php"], "src/Model/User.php"),
        ("csharp", "A.cs", "App.Tool", "using_static", ["src/App/Tool.cs"], "src/App/Tool.cs"),
        ("c", "src/a.c", "b.h", "include", ["include/b.h"], "include/b.h"),
        ("bash", "bin/a.sh", "../lib/b.sh", "source", ["lib/b.sh"], "lib/b.sh"),
        ("typescript", "src/a.ts", "./b.js", "import", ["src/b.ts"], "src/b.ts"),
        ("javascript", "src/a.js", "./d", "import", ["src/d/index.jsx"], "src/d/index.jsx"),
    ],
)
def test_candidates(language, source, target, kind, known, want):
    assert first(language, source, target, kind, known) == want


def test_external_targets_have_no_candidates():
    assert paths.candidates("csharp", "A.cs", "System.Linq", "using", paths.Context()) == []
    assert first("c", "a.c", "<stdio.h>", "include", ["stdio.h"]) is None
    assert first("c", "a.c", "<own/a.h>", "include", ["inc/own/a.h"]) == "inc/own/a.h"


def test_go_modules():
    ctx = paths.context_from({"go.mod": "module x.org/app\nreplace y.org/z => ./third/z\n", "sub/go.mod": "module x.org/app/sub\n"})
    assert paths.candidates("go", "cmd/main.go", "x.org/app/pkg", "import", ctx) == ["pkg/"]
    assert paths.candidates("go", "cmd/main.go", "y.org/z/q", "import", ctx) == ["third/z/q/"]
    assert paths.candidates("go", "sub/a.go", "x.org/app/sub/b", "import", ctx)[0] == "sub/b/"
    assert paths.candidates("go", "cmd/main.go", "fmt", "import", ctx) == []


def test_package_exports():
    table = {"./f/*": "./w/*.js", "./f/s": "./s.js", "./f/s/*": "./s/*.js", "./off": None, "./c": {"import": None, "default": "./no.js"}, "./arr": {"import": [None, "ext", "./a.js", "./b.js"]}}
    assert paths.export_targets(table, "./f/s") == ["./s.js"]
    assert paths.export_targets(table, "./f/s/b") == ["./s/b.js"]
    assert paths.export_targets(table, "./off") == [] and paths.export_targets(table, "./c") == []
    assert paths.export_targets(table, "./c", ("browser", "default")) == ["./no.js"]
    assert paths.export_targets(table, "./arr") == ["./a.js", "./b.js"]
    assert paths.export_targets(table, "./none") is None
    assert paths.export_targets("./i.js", ".") == ["./i.js"]
    assert paths.import_targets({"#x/*": "./src/*.ts"}, "#x/y") == ["./src/y.ts"]


def test_path_patterns():
    assert paths.captures("@s/*/c/*", "@s/admin/c/button") == ["admin", "button"]
    assert paths.apply_captures("src/*/c/*.ts", ["admin", "button"]) == "src/admin/c/button.ts"
    assert paths.apply_captures("src/*/*/*.ts", ["admin", "button"]) is None
    assert paths.best_mapping({"@a/*": 1, "@a/s": 2, "@a/s/*": 3}, "@a/s/b") == (3, ["b"])


def test_package_metadata():
    assert paths.metadata_entry({"module": "external", "main": "/x.js", "types": "./d.ts"}, ".") == "./d.ts"
    assert paths.metadata_entry({}, "./feature") == "feature"
    package = {"browser": {"./server.js": "./client.js", "plain.js": "./p.js", "./ext.js": "shim", "./off.js": False}}
    assert paths.browser_targets(package, "./s", ["./server.js"]) == ["./client.js"]
    assert paths.browser_targets(package, "./s", ["./plain.js"]) == ["./p.js"]
    assert paths.browser_targets(package, "./s", ["./ext.js", "./off.js"]) == []


def test_workspaces_and_catalogs():
    patterns, catalogs = paths.parse_pnpm('packages:\n  - "packages/**"\n  - "!packages/old"\ncatalog:\n  ui: ^1 # x\ncatalogs:\n  r18:\n    dom: ^18\n')
    assert paths.in_workspace(patterns, "packages/a/b") and not paths.in_workspace(patterns, "packages/old") and not paths.in_workspace(patterns, "apps/x")
    assert catalogs == {"default": {"ui"}, "r18": {"dom"}}
    assert (paths.catalog_name("catalog:"), paths.catalog_name("catalog:r18"), paths.catalog_name("^1")) == ("default", "r18", None)


def test_configuration_and_packages_resolve_scripts():
    ctx = paths.context_from(
        {
            "tsconfig.json": '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*"]}, } }',
            "web/tsconfig.json": '{"extends": "../tsconfig.json"}',
            "package.json": '{"name": "root", "workspaces": ["packages/*"], "imports": {"#int": "./src/int.ts"}}',
            "packages/ui/package.json": '{"name": "@x/ui", "exports": {".": "./main.js", "./b": {"import": "./b.js"}}}',
            "node_modules/dep/package.json": '{"name": "dep", "main": "./lib/index.js"}',
        }
    )
    known = {"src/a.ts", "src/int.ts", "packages/ui/main.js", "packages/ui/b.js", "node_modules/dep/lib/index.js"}
    want = {"@app/a": "src/a.ts", "#int": "src/int.ts", "@x/ui": "packages/ui/main.js", "@x/ui/b": "packages/ui/b.js", "@x/ui/no": None, "dep": "node_modules/dep/lib/index.js", "other": None}
    assert {t: first("typescript", "src/z.ts", t, "import", known, ctx) for t in want} == want
    assert first("typescript", "web/z.ts", "@app/a", "import", known, ctx) == "src/a.ts"
