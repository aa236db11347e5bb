"""From an edge's target to the paths it may mean, in order of preference.

``candidates`` is a pure function of one edge and of a small context that the driver
gathers (module names, source roots, package files). Which candidate exists is a join.
"""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, field

from codeloom.parse.lexer import comments_blanked

JS_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "json")
ROOTS = {
    "java": ("", "src/main/java", "src/test/java", "src", "app/src/main/java"),
    "csharp": ("", "src", "test", "tests"),
    "php": ("", "src", "app", "lib", "tests"),
    "ruby": ("lib", "app", "src", ""),
    "c": ("include", "includes", "inc"),
}
DEFAULT_CONDITIONS = ("import", "require", "node", "default")


@dataclass
class Context:
    go_modules: dict[str, str] = field(default_factory=dict)  # module path to folder
    go_replace: dict[str, str] = field(default_factory=dict)  # module path to folder
    go_work: dict[str, list[str]] = field(default_factory=dict)  # folder to the local folders that its workspace uses
    packages: dict[str, dict] = field(default_factory=dict)  # folder to its package file
    configs: dict[str, dict] = field(default_factory=dict)  # folder to its path configuration
    conditions: tuple[str, ...] = DEFAULT_CONDITIONS


def normalize(path: str) -> str:
    """Without '.', with '..' taken back; going above the root stays at the root."""
    parts: list[str] = []
    for p in path.replace("\\", "/").split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def join(*parts: str) -> str:
    return normalize("/".join(p for p in parts if p))


def ancestors(folder: str) -> list[str]:
    """The folder and the ones above it, the root ('') last."""
    out = [folder]
    while folder:
        folder = posixpath.dirname(folder)
        out.append(folder)
    return list(dict.fromkeys(out))


def _script_forms(base: str) -> list[str]:
    out = [base]
    stem, ext = posixpath.splitext(base)
    if ext in (".js", ".mjs", ".cjs", ".jsx"):  # sources that are written with the built name
        out += [stem + e for e in (".ts", ".tsx")]
    out += [f"{base}.{e}" for e in JS_EXTENSIONS] + [f"{base}/index.{e}" for e in JS_EXTENSIONS]
    return out


# --- mappings of script packages ------------------------------------------------------


def captures(pattern: str, value: str) -> list[str] | None:
    """What the stars of ``pattern`` stand for in ``value``; None if it does not fit."""
    m = re.fullmatch("(.*)".join(re.escape(p) for p in pattern.split("*")), value)
    return list(m.groups()) if m else None


def apply_captures(target: str, found: list[str]) -> str | None:
    """Fill the stars of ``target``; a single capture may fill several, otherwise the numbers must agree."""
    n = target.count("*")
    if n == 0:
        return target
    if len(found) == 1:
        return target.replace("*", found[0])
    if n != len(found):
        return None
    for f in found:
        target = target.replace("*", f, 1)
    return target


def best_mapping(mappings: dict, value: str) -> tuple[object, list[str]] | None:
    """The exact entry, or the pattern with the longest text before its star."""
    if value in mappings and "*" not in value:
        return mappings[value], []
    fits = [(k, captures(k, value)) for k in mappings if "*" in k]
    fits = [(k, c) for k, c in fits if c is not None]
    if not fits:
        return None
    key, found = max(fits, key=lambda kc: (len(kc[0].split("*")[0]), len(kc[0])))
    return mappings[key], found


def condition_targets(entry: object, conditions: tuple[str, ...]) -> list[str]:
    """Local targets of an entry by the first condition it has; arrays keep their order."""
    if isinstance(entry, str):
        return [entry] if entry.startswith("./") else []
    if isinstance(entry, list):
        return [t for e in entry for t in condition_targets(e, conditions)]
    if isinstance(entry, dict):
        for c in conditions:
            if c in entry:
                return condition_targets(entry[c], conditions)
    return []


def export_targets(exports: object, subpath: str, conditions: tuple[str, ...] = DEFAULT_CONDITIONS) -> list[str] | None:
    """Targets of a package subpath; [] if it is closed, None if it is not named."""
    if isinstance(exports, dict) and any(k.startswith(".") for k in exports):
        found = best_mapping(exports, subpath)
    else:
        found = (exports, []) if subpath == "." and exports is not None else None
    if found is None:
        return None
    entry, caught = found
    filled = (apply_captures(t, caught) for t in condition_targets(entry, conditions))
    return [t for t in filled if t]


def import_targets(imports: dict, name: str, conditions: tuple[str, ...] = DEFAULT_CONDITIONS) -> list[str] | None:
    found = best_mapping(imports, name)
    if found is None:
        return None
    filled = (apply_captures(t, found[1]) for t in condition_targets(found[0], conditions))
    return [t for t in filled if t]


def browser_targets(package: dict, subpath: str, targets: list[str]) -> list[str]:
    """Targets that the package's browser field replaces; a shim outside of the package or false gives none."""
    browser = package.get("browser")
    if isinstance(browser, str):
        return [browser] if subpath == "." and browser.startswith("./") else []
    if not isinstance(browser, dict):
        return []
    plain = lambda p: p.removeprefix("./")
    table = {plain(k): v for k, v in browser.items()}
    out = [table.get(plain(t)) for t in targets]
    return [t for t in out if isinstance(t, str) and t.startswith("./")]


def metadata_entry(package: dict, subpath: str) -> str | None:
    """Entry of a package without exports: module, main, types or typings if local; subpaths name themselves."""
    if subpath != ".":
        return subpath.removeprefix("./")
    for k in ("source", "module", "main", "types", "typings"):
        v = package.get(k)
        if isinstance(v, str) and v.startswith("./"):
            return v
        if isinstance(v, str) and v and not v.startswith("/") and ("/" in v or posixpath.splitext(v)[1]):
            return "./" + v
    return None


def specifier_parts(target: str) -> tuple[str, str]:
    """Package name and subpath ('.' for the package itself)."""
    parts = target.split("/")
    n = 2 if target.startswith("@") else 1
    rest = "/".join(parts[n:])
    return "/".join(parts[:n]), f"./{rest}" if rest else "."


def _package_entry(folder: str, package: dict, subpath: str, ctx: Context) -> list[str] | None:
    """Paths of a package entry; [] if its exports close it."""
    if "exports" in package:
        targets = export_targets(package["exports"], subpath, ctx.conditions)
        if targets is None:
            return []
    else:
        entry = metadata_entry(package, subpath)
        targets = [entry] if entry else ["index"]
    targets = browser_targets(package, subpath, targets) + targets if "browser" in ctx.conditions else targets
    return [p for t in targets for p in _script_forms(join(folder, t))]


def workspace_match(pattern: str, folder: str) -> bool:
    """A workspace pattern, '**' for any depth, a trailing slash ignored."""
    body = re.escape(pattern.strip("/").removeprefix("./")).replace(r"\*\*", ".*").replace(r"\*", "[^/]*")
    return re.fullmatch(body, folder) is not None


def workspace_patterns(package: dict) -> list[str]:
    w = package.get("workspaces")
    w = w.get("packages") if isinstance(w, dict) else w
    return [p for p in w if isinstance(p, str)] if isinstance(w, list) else []


def in_workspace(patterns: list[str], folder: str) -> bool:
    """A pattern that begins with '!' takes folders out again."""
    inside = any(workspace_match(p, folder) for p in patterns if not p.startswith("!"))
    return inside and not any(workspace_match(p[1:], folder) for p in patterns if p.startswith("!"))


def catalog_name(version: str) -> str | None:
    """'catalog:' means the default catalog, 'catalog:x' the catalog x, anything else none."""
    return (version.removeprefix("catalog:") or "default") if version.startswith("catalog:") else None


def parse_pnpm(text: str) -> tuple[list[str], dict[str, set[str]]]:
    """(package patterns, names by catalog) of a workspace file, by indentation."""
    patterns: list[str] = []
    catalogs: dict[str, set[str]] = {}
    section, name = None, None
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if indent == 0:
            section, name = body.split(":")[0], "default"
        elif section == "packages" and body.startswith("-"):
            patterns.append(body[1:].strip().strip("\"'"))
        elif section == "catalog" and ":" in body:
            catalogs.setdefault("default", set()).add(body.split(":")[0].strip("\"' "))
        elif section == "catalogs" and ":" in body:
            key, value = body.split(":", 1)
            if not value.strip():
                name = key.strip("\"' ")
            else:
                catalogs.setdefault(name, set()).add(key.strip("\"' "))
    return patterns, catalogs


def _javascript(source: str, target: str, ctx: Context) -> list[str]:
    folder = posixpath.dirname(source)
    if target.startswith((".", "/")):
        return _script_forms(join(folder, target) if target.startswith(".") else normalize(target))
    own = next((a for a in ancestors(folder) if a in ctx.packages), None)
    if target.startswith("#"):
        found = import_targets(ctx.packages[own].get("imports") or {}, target, ctx.conditions) if own is not None else None
        return [p for t in found or [] for p in _script_forms(join(own, t))]
    out: list[str] = []
    near = next((a for a in ancestors(folder) if a in ctx.configs), None)
    if near is not None:
        options = config_options(near, ctx)
        found = best_mapping(options["paths"], target)
        for t in found[0] if found and isinstance(found[0], list) else []:
            filled = apply_captures(t, found[1])
            if filled:
                out += _script_forms(join(options["base"], filled))
        if options["has_base"]:
            out += _script_forms(join(options["base"], target))
    name, subpath = specifier_parts(target)
    if own is not None and ctx.packages[own].get("name") == name:
        return out + (_package_entry(own, ctx.packages[own], subpath, ctx) or [])
    for a in ancestors(folder):
        patterns = workspace_patterns(ctx.packages.get(a, {}))
        for f, package in sorted(ctx.packages.items()) if patterns else ():
            inner = f.removeprefix(a + "/") if a else f
            if package.get("name") == name and f != a and in_workspace(patterns, inner):
                out += _package_entry(f, package, subpath, ctx) or []
    for a in ancestors(folder):
        f = join(a, "node_modules", name)
        out += (_package_entry(f, ctx.packages[f], subpath, ctx) or []) if f in ctx.packages else []
    return out


def config_options(folder: str, ctx: Context, seen: frozenset = frozenset()) -> dict:
    """paths and base of a configuration; what it does not set comes from the one it extends. Cycles end."""
    raw = ctx.configs.get(folder, {})
    options = raw.get("compilerOptions") or {}
    out = {"paths": {}, "base": folder, "has_base": False}
    parent = raw.get("extends")
    if isinstance(parent, str) and parent.startswith("."):
        at = join(folder, parent)
        at = at if at in ctx.configs else posixpath.dirname(at)
        if at not in seen | {folder} and at in ctx.configs:
            out = config_options(at, ctx, seen | {folder})
    if isinstance(options.get("baseUrl"), str):
        out |= {"base": join(folder, options["baseUrl"]), "has_base": True}
    if isinstance(options.get("paths"), dict):
        out["paths"] = options["paths"]
        if "baseUrl" not in options and not out["has_base"]:
            out["base"] = folder
    return out


# --- other languages --------------------------------------------------------------------


def _python(source: str, target: str) -> list[str]:
    dots = len(target) - len(target.lstrip("."))
    base, parts = "", [p for p in target.lstrip(".").split(".") if p]
    if dots:
        base = posixpath.dirname(source)
        for _ in range(dots - 1):
            base = posixpath.dirname(base)
    out = []
    for n in range(len(parts), -1 if dots else 0, -1):
        p = join(base, *parts[:n])
        out += [p + ".py", join(p, "__init__.py")] if p else (["__init__.py"] if dots else [])
    return out


def _snake(name: str) -> str:
    return "/".join(re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", p).lower() for p in name.split("::"))


def _rust(source: str, target: str, kind: str) -> list[str]:
    folder, stem = posixpath.dirname(source), posixpath.splitext(posixpath.basename(source))[0]
    here = folder if stem in ("mod", "lib", "main") else join(folder, stem)
    if kind == "mod":
        return [join(here, target + ".rs"), join(here, target, "mod.rs"), join(folder, target + ".rs"), join(folder, target, "mod.rs")]
    parts = target.split("::")
    crate = next((a for a in ancestors(folder) if posixpath.basename(a) == "src"), folder)
    base, rest = crate, parts[1:]
    if parts[0] == "self":
        base = here
    elif parts[0] == "super":
        base = here
        while parts and parts[0] == "super":
            base, parts = posixpath.dirname(base), parts[1:]
        rest = parts
    elif parts[0] != "crate":
        base, rest = here, parts
    out = []
    for n in range(len(rest), 0, -1):
        p = join(base, *rest[:n])
        out += [p + ".rs", join(p, "mod.rs")]
    if parts and parts[0] == "crate":
        out += [join(crate, "lib.rs"), join(crate, "main.rs")]
    return out


def _go(source: str, target: str, ctx: Context) -> list[str]:
    """Folders of a package, marked by a trailing slash: a representative file is chosen by the join.

    The nearest module comes first, then local replacements, the longest first, then the
    modules that the nearest workspace uses.
    """
    folder = posixpath.dirname(source)
    within = lambda module: target == module or target.startswith(module + "/")
    above = ancestors(folder)
    near = sorted((above.index(f), m, f) for m, f in ctx.go_modules.items() if f in above)[:1]
    named = [(m, f) for _, m, f in near]
    named += sorted(ctx.go_replace.items(), key=lambda mf: -len(mf[0]))
    work = next((a for a in above if a in ctx.go_work), None)
    used = {join(work, u) for u in ctx.go_work[work]} if work is not None else set()
    named += sorted(((m, f) for m, f in ctx.go_modules.items() if f in used), key=lambda mf: -len(mf[0]))
    return [join(f, target[len(m) :]) + "/" for m, f in named if within(m)]


def candidates(language: str, source: str, target: str, kind: str, ctx: Context) -> list[str]:
    """Paths in order of preference; a trailing slash stands for some file of a folder."""
    folder = posixpath.dirname(source)
    if language == "python":
        out = _python(source, target) if kind != "base_type" else []
    elif language in ("javascript", "typescript", "tsx"):
        out = _javascript(source, target, ctx) if kind != "base_type" else []
    elif language == "go":
        out = _go(source, target, ctx) if kind == "import" else []
    elif language == "bash":
        out = [join(folder, target)] if not target.startswith("/") else []
        out += [normalize(target)] if "/" in target else []
    elif language in ("c", "cpp"):
        roots = [join(r, target.strip("<>")) for r in ROOTS["c"]]
        out = [] if kind != "include" else roots if target.startswith("<") else [join(folder, target), normalize(target), *roots]
    elif language == "java":
        parts = target.removesuffix(".*").split(".")
        shorter = [parts[:n] for n in range(len(parts), 1, -1)] if kind == "import_static" else [parts]
        out = [join(r, *p) + ".java" for p in shorter for r in ROOTS["java"]] if kind in ("import", "import_static") else []
        out += [join(folder, target + ".java")] if kind == "base_type" else []
    elif language == "csharp":
        external = target.split(".")[0] in ("System", "Microsoft")
        parts = target.split(".")
        out = [] if external or kind in ("namespace", "type_binding", "property_type", "extension_method") else [join(r, *parts) + ".cs" for r in ROOTS["csharp"]] + [join(r, *parts) + "/" for r in ROOTS["csharp"]]
        out = [join(folder, *parts) + ".cs"] + out if kind == "base_type" and not external else out
    elif language == "php":
        parts = target.split("\\")
        forms = [parts] + ([parts[1:]] if parts[0] == "App" and len(parts) > 1 else [])
        out = [join(r, *p) + ".php" for p in forms for r in ROOTS["php"]] if kind in ("use", "base_type") else []
        out = [join(folder, *parts) + ".php"] + out if kind == "base_type" else out
    elif language == "ruby":
        if kind == "base_type":
            out = [join(r, _snake(target) + ".rb") for r in (folder, *ROOTS["ruby"])]
        else:
            base = join(folder, target) if kind == "require_relative" else None
            forms = [base] if base else [join(r, target) for r in ROOTS["ruby"]]
            out = [f for b in forms for f in ((b,) if b.endswith(".rb") else (b + ".rb", b))]
    elif language == "rust":
        out = _rust(source, target, kind) if kind != "base_type" else []
    else:
        out = []
    return [c for c in dict.fromkeys(out) if c and c != source]


def parse_go_mod(text: str) -> tuple[str | None, dict[str, str]]:
    """(module, local replacements) of a module file."""
    module = re.search(r"^\s*module\s+(\S+)", text, re.M)
    plain = re.sub(r"//[^\n]*", "", text)
    replaced = dict(re.findall(r"^\s*(?:replace\s+)?(\S+)(?:\s+v\S+)?\s*=>\s*(\.{1,2}/\S*|\.{1,2})", plain, re.M))
    return module[1].strip('"') if module else None, replaced


def parse_go_work(text: str) -> list[str]:
    """Local folders that a workspace file uses, one by one or in a block; others are left out."""
    plain = re.sub(r"//[^\n]*", "", text)
    uses = re.findall(r"^[ \t]*use[ \t]+([^\s(]+)", plain, re.M)
    for block in re.findall(r"^[ \t]*use[ \t]*\(([^)]*)\)", plain, re.M):
        uses += [line.split()[0] for line in block.splitlines() if line.split()]
    return [u for u in (x.strip("\"`") for x in uses) if u.startswith(".")]


def context_from(texts: dict[str, str], conditions: tuple[str, ...] = DEFAULT_CONDITIONS) -> Context:
    """Context of the metadata files of a tree (path to text): module, package and path configuration files."""
    ctx = Context(conditions=conditions)
    for path, text in sorted(texts.items()):
        folder, name = posixpath.dirname(path), posixpath.basename(path)
        if name == "go.mod":
            module, replaced = parse_go_mod(text)
            if module:
                ctx.go_modules[module] = folder
            ctx.go_replace |= {m: join(folder, to) for m, to in replaced.items()}
        elif name == "go.work":
            ctx.go_work[folder] = parse_go_work(text)
        elif name in ("package.json", "tsconfig.json", "jsconfig.json"):
            try:
                # path configurations may have comments and trailing commas
                raw = json.loads(text if name == "package.json" else re.sub(r",(\s*[}\]])", r"\1", comments_blanked(text, "javascript")))
            except ValueError:
                continue
            if isinstance(raw, dict):
                if name == "package.json":
                    ctx.packages[folder] = raw
                elif name == "tsconfig.json" or folder not in ctx.configs:
                    ctx.configs[folder] = raw
        elif name == "pnpm-workspace.yaml":
            patterns, _ = parse_pnpm(text)
            ctx.packages.setdefault(folder, {}).setdefault("workspaces", patterns)
    return ctx
