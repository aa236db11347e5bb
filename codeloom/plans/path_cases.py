"""Targets of each language with the file that they lead to, for path resolution.

``{k}`` stands for a supplier's key. Rows are language, source file, target, kind and
the file that is to be found, written down by hand; FILES are the paths that exist.
"""

from __future__ import annotations

FILES: dict[str, list[str]] = {}
METADATA: dict[str, dict[str, str]] = {}
TARGETS: dict[str, list[tuple[str, str, str, str, str | None]]] = {}

FILES["bash"] = ["bin/run{k}.sh", "bin/lib{k}.sh", "shared/env{k}.sh", "tools/x{k}.sh"]
TARGETS["bash"] = [
    ("bash", "bin/run{k}.sh", "./lib{k}.sh", "source", "bin/lib{k}.sh"),
    ("bash", "bin/run{k}.sh", "../shared/env{k}.sh", "source", "shared/env{k}.sh"),
    ("bash", "bin/run{k}.sh", "tools/x{k}.sh", "source", "tools/x{k}.sh"),
    ("bash", "bin/run{k}.sh", "none{k}.sh", "source", None),
]

FILES["go"] = ["cmd/run{k}.go", "tool{k}/doc.go", "tool{k}/do_test.go", "tool{k}/do.go", "vendored/log{k}/log.go", "apps/web/main{k}.go", "libs/report/sum{k}/sum.go", "other/far{k}/far.go"]
METADATA["go"] = {
    "go.mod": "module x.org/app\n\nreplace y.org/log => ./vendored\n", "apps/web/go.mod": "module x.org/web\n", "libs/report/go.mod": "module z.org/report\n", "other/go.mod": "module q.org/other\n",
    "go.work": "go 1.22\nuse ./apps/web\nuse (\n    ./libs/report // local\n    /tmp/absolute\n)\n",
}
TARGETS["go"] = [
    ("go", "cmd/run{k}.go", "x.org/app/tool{k}", "import", "tool{k}/do.go"),  # neither documentation nor a test
    ("go", "cmd/run{k}.go", "y.org/log/log{k}", "import", "vendored/log{k}/log.go"),
    ("go", "apps/web/main{k}.go", "z.org/report/sum{k}", "import", "libs/report/sum{k}/sum.go"),  # by the workspace
    ("go", "apps/web/main{k}.go", "x.org/app/tool{k}", "import", None),  # not the nearest module, not in the workspace
    ("go", "cmd/run{k}.go", "q.org/other/far{k}", "import", None),
    ("go", "cmd/run{k}.go", "fmt", "import", None),
    ("go", "cmd/run{k}.go", "main", "package", None),
]

FILES["csharp"] = ["src/App/Core/Svc{k}.cs", "src/App/Model{k}/Zeta.cs", "src/App/Model{k}/Alpha.cs", "App/Tools/Tool{k}.cs", "src/App/Core/Base{k}.cs"]
TARGETS["csharp"] = [
    ("csharp", "src/App/Core/Svc{k}.cs", "App.Tools.Tool{k}", "using_static", "App/Tools/Tool{k}.cs"),
    ("csharp", "src/App/Core/Svc{k}.cs", "App.Model{k}", "using", "src/App/Model{k}/Alpha.cs"),  # the first of the folder
    ("csharp", "src/App/Core/Svc{k}.cs", "Base{k}", "base_type", "src/App/Core/Base{k}.cs"),
    ("csharp", "src/App/Core/Svc{k}.cs", "System.Text", "using", None),
    ("csharp", "src/App/Core/Svc{k}.cs", "Microsoft.Extensions", "using", None),
]

FILES["java"] = ["src/main/java/a/b/Svc{k}.java", "src/main/java/a/b/Tool{k}.java", "src/test/java/a/Probe{k}.java", "src/main/java/a/b/Near{k}.java"]
TARGETS["java"] = [
    ("java", "src/main/java/a/b/Svc{k}.java", "a.b.Tool{k}", "import", "src/main/java/a/b/Tool{k}.java"),
    ("java", "src/main/java/a/b/Svc{k}.java", "a.b.Tool{k}.go", "import_static", "src/main/java/a/b/Tool{k}.java"),  # by a shorter prefix
    ("java", "src/main/java/a/b/Svc{k}.java", "a.Probe{k}", "import", "src/test/java/a/Probe{k}.java"),
    ("java", "src/main/java/a/b/Svc{k}.java", "Near{k}", "base_type", "src/main/java/a/b/Near{k}.java"),
    ("java", "src/main/java/a/b/Svc{k}.java", "java.util.List", "import", None),
]

FILES["php"] = ["src/Service/Svc{k}.php", "src/Model/User{k}.php", "app/Http/Kernel{k}.php", "src/Service/Base{k}.php"]
TARGETS["php"] = [
    ("php", "src/Service/Svc{k}.php", "Model\\User{k}", "use", "src/Model/User{k}.php"),
    ("php", "src/Service/Svc{k}.php", "App\\Http\\Kernel{k}", "use", "app/Http/Kernel{k}.php"),  # without the App prefix
    ("php", "src/Service/Svc{k}.php", "Base{k}", "base_type", "src/Service/Base{k}.php"),
    ("php", "src/Service/Svc{k}.php", "Vendor\\Thing{k}", "use", None),
]

FILES["python"] = ["app/main{k}.py", "app/util{k}.py", "app/sub{k}/__init__.py", "lib{k}/core.py", "app/__init__.py"]
TARGETS["python"] = [
    ("python", "app/main{k}.py", ".util{k}", "import", "app/util{k}.py"),
    ("python", "app/main{k}.py", ".util{k}.helper", "import", "app/util{k}.py"),  # the member falls away
    ("python", "app/main{k}.py", ".sub{k}", "import", "app/sub{k}/__init__.py"),
    ("python", "app/sub{k}/__init__.py", "..util{k}", "import", "app/util{k}.py"),
    ("python", "app/main{k}.py", "lib{k}.core.run", "import", "lib{k}/core.py"),
    ("python", "app/main{k}.py", ".", "import", "app/__init__.py"),
    ("python", "app/main{k}.py", "os", "import", None),
    ("python", "app/main{k}.py", "Base{k}", "base_type", None),
]

FILES["ruby"] = ["lib/app{k}.rb", "lib/tools/my_tool{k}.rb", "app/http_server{k}.rb", "lib/plain{k}.rb"]
TARGETS["ruby"] = [
    ("ruby", "lib/app{k}.rb", "tools/my_tool{k}", "require_relative", "lib/tools/my_tool{k}.rb"),
    ("ruby", "lib/app{k}.rb", "plain{k}", "require", "lib/plain{k}.rb"),
    ("ruby", "lib/app{k}.rb", "HTTPServer{k}", "base_type", "app/http_server{k}.rb"),
    ("ruby", "lib/app{k}.rb", "json", "require", None),
]

FILES["rust"] = ["src/lib.rs", "src/net{k}.rs", "src/net{k}/wire.rs", "src/core{k}/mod.rs", "src/core{k}/deep.rs"]
TARGETS["rust"] = [
    ("rust", "src/lib.rs", "net{k}", "mod", "src/net{k}.rs"),
    ("rust", "src/lib.rs", "core{k}", "mod", "src/core{k}/mod.rs"),
    ("rust", "src/net{k}.rs", "wire", "mod", "src/net{k}/wire.rs"),
    ("rust", "src/net{k}.rs", "crate::core{k}::deep::Item", "use", "src/core{k}/deep.rs"),  # the longest prefix
    ("rust", "src/net{k}/wire.rs", "super::wire::run", "use", None),
    ("rust", "src/core{k}/deep.rs", "super::deep::go", "use", None),
    ("rust", "src/net{k}.rs", "self::wire::Frame", "use", "src/net{k}/wire.rs"),
    ("rust", "src/net{k}.rs", "std::fmt", "use", None),
]

FILES["c"] = ["src/main{k}.c", "src/near{k}.h", "include/api{k}.h", "include/twin{k}.h", "inc/twin{k}.h", "deep/far{k}.h"]
TARGETS["c"] = [
    ("c", "src/main{k}.c", "near{k}.h", "include", "src/near{k}.h"),
    ("c", "src/main{k}.c", "deep/far{k}.h", "include", "deep/far{k}.h"),
    ("c", "src/main{k}.c", "<api{k}.h>", "include", "include/api{k}.h"),
    ("c", "src/main{k}.c", "api{k}.h", "include", "include/api{k}.h"),
    ("c", "src/main{k}.c", "<twin{k}.h>", "include", None),  # two roots have it
    ("cpp", "src/main{k}.c", "twin{k}.h", "include", None),
    ("c", "src/main{k}.c", "<stdio.h>", "include", None),
]

FILES["script"] = [
    "src/a{k}.ts", "src/b{k}.ts", "src/dir{k}/index.ts", "lib/shared{k}.ts", "lib/exact.ts", "packages/ui/src/button{k}.ts", "packages/ui/src/index.ts", "packages/old/x{k}.ts",
    "node_modules/dep/dist/main.js", "node_modules/dep/dist/feature{k}.js", "node_modules/plain/lib/entry.js", "src/internal/hash{k}.ts", "src/self{k}.ts",
]
METADATA["script"] = {
    "package.json": '{"name": "root", "workspaces": ["packages/*", "!packages/old"], "imports": {"#hash/*": "./src/internal/*.ts", "#shut": null}, "exports": {"./self/*": "./src/*.ts"}}',
    "tsconfig.json": '{"extends": "./tsconfig.base.json", // comment\n "compilerOptions": {"paths": {"@lib/*": ["lib/*"], "@lib/exact": ["lib/exact.ts"],}}}',
    "packages/ui/package.json": '{"name": "@w/ui", "exports": {".": "./src/index.ts", "./*": {"node": "./src/*.ts", "default": "./none/*.js"}, "./secret": null}}',
    "packages/old/package.json": '{"name": "@w/old", "main": "./x.ts"}',
    "node_modules/dep/package.json": '{"name": "dep", "exports": {".": ["./dist/main.js"], "./f/*": {"import": "./dist/*.js"}}}',
    "node_modules/plain/package.json": '{"name": "plain", "main": "lib/entry.js"}',
}
TARGETS["script"] = [
    ("typescript", "src/a{k}.ts", "./b{k}", "import", "src/b{k}.ts"),
    ("typescript", "src/a{k}.ts", "./dir{k}", "import", "src/dir{k}/index.ts"),
    ("javascript", "src/a{k}.ts", "./none{k}", "require", None),
    ("typescript", "src/a{k}.ts", "@lib/shared{k}", "import", "lib/shared{k}.ts"),  # path configuration with a capture
    ("typescript", "src/a{k}.ts", "@lib/exact", "import", "lib/exact.ts"),  # exact before the longest prefix
    ("typescript", "src/a{k}.ts", "#hash/hash{k}", "import", "src/internal/hash{k}.ts"),  # package imports
    ("typescript", "src/a{k}.ts", "#shut", "import", None),
    ("typescript", "src/a{k}.ts", "root/self/self{k}", "import", "src/self{k}.ts"),  # its own exports
    ("typescript", "src/a{k}.ts", "@w/ui", "import", "packages/ui/src/index.ts"),  # a workspace
    ("typescript", "src/a{k}.ts", "@w/ui/button{k}", "import", "packages/ui/src/button{k}.ts"),  # by condition
    ("typescript", "src/a{k}.ts", "@w/ui/secret", "import", None),  # closed by its exports
    ("typescript", "src/a{k}.ts", "@w/old", "import", None),  # excluded from the workspace
    ("javascript", "src/a{k}.ts", "dep", "import", "node_modules/dep/dist/main.js"),
    ("javascript", "src/a{k}.ts", "dep/f/feature{k}", "import", "node_modules/dep/dist/feature{k}.js"),
    ("tsx", "src/a{k}.ts", "plain", "import", "node_modules/plain/lib/entry.js"),
    ("typescript", "src/a{k}.ts", "absent{k}", "import", None),
]
