"""Extraction of one file: (symbols, dependencies, calls) as plain tuples.

Python is parsed exactly, JavaScript and TypeScript are walked by their brackets. The
other languages are read by rules over masked text: declarations by pattern, their end
by matching brackets (Ruby: by indentation), scopes by nesting. Rows carry ``extractor`` so that users see which it was.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from codeloom.parse import script
from codeloom.parse.lexer import comments_blanked, dotted, line_of, mask, matching, split_top, string_value, strip_generics

UNRESOLVED, SAME_FILE = 0.55, 0.72
MODULE = "<module>"


@dataclass
class Symbol:
    name: str
    qualified_name: str
    kind: str
    start_line: int
    end_line: int


@dataclass
class Dependency:
    target: str
    kind: str
    line: int
    local_alias: str | None = None
    imported_symbol: str | None = None


@dataclass
class Call:
    caller: str
    callee: str
    line: int
    column: int


@dataclass
class Extract:
    symbols: list[Symbol] = field(default_factory=list)
    dependencies: list[Dependency] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    extractor: str = "rules"


# --- Python --------------------------------------------------------------------------


class _Python(ast.NodeVisitor):
    def __init__(self) -> None:
        self.out, self.scope, self.classes, self.functions = Extract(extractor="ast"), [], [], []

    def _declare(self, node, kind: str) -> None:
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        self.out.symbols.append(Symbol(node.name, ".".join([*self.scope, node.name]), kind, start, node.end_lineno))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._declare(node, "class")
        for base in node.bases:
            name = _dotted_ast(base)
            if name:
                self.out.dependencies.append(Dependency(name, "base_type", node.lineno, None, node.name))
        self.scope.append(node.name)
        self.classes.append(True)
        self.generic_visit(node)
        self.scope.pop()
        self.classes.pop()

    def _function(self, node) -> None:
        self._declare(node, "method" if self.classes and self.classes[-1] else "function")
        self.functions.append(".".join([*self.scope, node.name]))
        self.classes.append(False)
        self.generic_visit(node)
        self.classes.pop()
        self.functions.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            alias = a.asname or a.name
            self.out.dependencies.append(Dependency(a.name, "import", node.lineno, alias, "*"))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.out.dependencies.append(Dependency(module, "import", node.lineno))
        for a in node.names:
            if a.name != "*":
                member = module + a.name if module.endswith(".") else f"{module}.{a.name}"
                self.out.dependencies.append(Dependency(member, "import", node.lineno, a.asname or a.name, a.name))

    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted_ast(node.func)
        if name:
            self.out.calls.append(Call(self.functions[-1] if self.functions else MODULE, name, node.lineno, node.col_offset + 1))
        self.generic_visit(node)


def _dotted_ast(node: ast.AST) -> str | None:
    """a.b.c of names and attributes; calls and subscripts on the way are passed over."""
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Subscript):
            node = node.value
        elif isinstance(node, ast.Name):
            parts.append(node.id)
            return ".".join(reversed(parts))
        else:
            return None


def python_extract(text: str) -> Extract:
    visitor = _Python()
    visitor.visit(ast.parse(text))
    return visitor.out


# --- rules -----------------------------------------------------------------------------

ID = r"[A-Za-z_$][\w$]*"
TYPE_KINDS = {"class": "class", "struct": "struct", "interface": "interface", "trait": "interface", "enum": "class", "record": "class", "module": "class", "type": "struct", "impl": "impl"}
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|virtual|override|readonly|export|default|extern|unsafe|inline|synchronized|native|const|declare|open|new)\s+)*"

#: A C# type, with type arguments and array marks.
_CS_TYPE = r"[\w.]+(?:<[^;{}()=]*>)?(?:\[[\s,]*\])*\??"

# Declarations of each language: (pattern, kind or None for the keyword's own, body).
# Group "name" is the name, "key" the keyword; a body is a brace block, an end or a line.
RULES: dict[str, list[tuple[str, str | None, str]]] = {
    "bash": [(rf"^[ \t]*(?:function\s+(?P<name>{ID})\s*(?:\(\s*\))?|(?P<name2>{ID})\s*\(\s*\))\s*\{{", "function", "brace")],
    "c": [
        (rf"\b(?P<key>struct|enum)\s+(?P<name>{ID})\s*\{{", None, "brace"),
        (rf"\btypedef\s+(?P<key>struct|enum|union)\b[^;{{]*\{{[^}}]*\}}\s*(?P<name>{ID})\s*;", "struct", "line"),
        (rf"^(?!\s*(?:return|else|typedef|if|for|while|switch|do|case|goto)\b)[ \t]*(?:{ID}[\s*&]+)+(?P<name>{ID})\s*\([^;{{}}]*\)\s*\{{", "function", "brace"),
    ],
    "cpp": [
        (rf"\b(?P<key>class|struct|enum)\s+(?P<name>{ID})\b[^;{{()]*\{{", None, "brace"),
        (rf"^(?!\s*(?:return|else|typedef|if|for|while|switch|do|case|goto|using|public|private|protected)\b)[ \t]*(?:template\s*<[^>]*>\s*)?(?:[\w:<>,~]+[\s*&]+)*(?P<name>~?{ID}(?:::~?{ID})*)\s*\([^;{{}}]*\)[^;{{}}]*\{{", "function", "brace"),
    ],
    "csharp": [
        (rf"\b(?P<key>class|struct|interface|enum|record)\s+(?P<name>{ID})\b[^;{{]*\{{", None, "brace"),
        (rf"^[ \t]*{_MODS}(?!return\b|new\b|else\b|throw\b|await\b|using\b|namespace\b)[\w<>\[\],.? ]+\s+(?P<name>{ID})\s*(?:<[^>]*>)?\s*\([^;{{}}]*\)[^;{{}}=]*(?:\{{|=>)", "method", "brace"),
        (rf"^[ \t]*(?:public|private|protected|internal)\s+(?P<name>{ID})\s*\([^;{{}}]*\)[^;{{}}]*\{{", "method", "brace"),
        (rf"(?:^|(?<=[{{;}}]))[ \t]*{_MODS}{_CS_TYPE}\s+(?P<name>{ID})\s*\{{\s*(?:get|set|init|private|protected|internal)\b", "variable", "brace"),
    ],
    "go": [
        (rf"^type\s+(?P<name>{ID})\s+(?P<key>struct|interface)\s*\{{", None, "brace"),
        (rf"^func\s+\(\s*(?:{ID}\s+)?\*?(?P<owner>{ID})[^)]*\)\s*(?P<name>{ID})\s*(?:\[[^\]]*\])?\(", "method", "brace"),
        (rf"^func\s+(?P<name>{ID})\s*(?:\[[^\]]*\])?\(", "function", "brace"),
        (rf"^(?:const)\s+(?P<name>{ID})\b", "constant", "line"),
        (rf"^(?:var)\s+(?P<name>{ID})\b", "variable", "line"),
    ],
    "java": [
        (rf"\b(?P<key>class|interface|enum|record)\s+(?P<name>{ID})\b[^;{{]*\{{", None, "brace"),
        (rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?:<[^>]+>\s*)?(?!return\b|new\b|else\b|throw\b)(?:[\w<>\[\],.?]+\s+)(?P<name>{ID})\s*\([^;{{}}]*\)[^;{{}}]*\{{", "method", "brace"),
        (rf"^[ \t]*(?:public|private|protected)\s+(?P<name>{ID})\s*\([^;{{}}]*\)[^;{{}}]*\{{", "method", "brace"),
        (rf"^[ \t]*(?:public|private|protected)\s+(?:(?:static|final|transient|volatile)\s+)*[\w<>\[\],.?]+\s+(?P<name>{ID})\s*(?:=[^;]*|,[^;]*)?;", "variable", "line"),
    ],
    "php": [
        (rf"\b(?P<key>class|interface|trait|enum)\s+(?P<name>{ID})\b[^;{{]*\{{", None, "brace"),
        (rf"\bfunction\s+&?(?P<name>{ID})\s*\(", "function", "brace"),
        (rf"^[ \t]*(?:(?:public|private|protected|static|readonly|var)\s+)+(?:\??[\w\\|]+\s+)?(?P<name>\${ID})\s*[=;]", "variable", "line"),
        (rf"\bconst\s+(?P<name>{ID})\s*=", "constant", "line"),
    ],
    "ruby": [
        (r"^[ \t]*(?P<key>class|module)\s+(?P<name>[A-Z]\w*(?:::[A-Z]\w*)*)", None, "end"),
        (r"^[ \t]*def\s+(?:self\.)?(?P<name>[a-zA-Z_]\w*[?!=]?)", "method", "end"),
        (r"^[ \t]*(?P<name>[A-Z][A-Z0-9_]*)\s*=[^=]", "constant", "line"),
    ],
    "rust": [
        (rf"\b(?P<key>struct|enum|trait)\s+(?P<name>{ID})", None, "brace"),
        (rf"^[ \t]*(?:unsafe\s+)?(?P<key>impl)\b(?:\s*<[^{{]*?>)?\s+(?:[\w:<>, &']+?\s+for\s+)?(?P<name>{ID})[^;{{]*\{{", None, "brace"),
        (rf"\bfn\s+(?P<name>{ID})", "function", "brace"),
        (rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z_][A-Z0-9_]*)\s*:", "constant", "line"),
    ],
}
COMPILED = {k: [(re.compile(p, re.M), kind, body) for p, kind, body in rules] for k, rules in RULES.items()}

# Words that look like calls or type names but are none: fixed values, for all languages and by language.
COMMON = frozenset("if for while switch catch return new throw do else case default class try finally break continue super".split())
OWN = {
    "bash": "then elif fi until done esac function in select",
    "c": "sizeof goto typedef struct enum union alignof static_assert",
    "cpp": "sizeof goto typedef struct enum union alignof static_assert decltype delete operator template typename namespace noexcept",
    "csharp": "foreach using lock fixed checked unchecked when nameof sizeof typeof await stackalloc is as in out ref base",
    "go": "func go defer range chan map select interface struct type var const package import",
    "java": "synchronized assert instanceof",
    "javascript": "function typeof instanceof await yield delete void in of import require export let var const async",
    "php": "function fn foreach elseif match array list isset empty unset echo print include include_once require require_once",
    "python": "",
    "ruby": "def module unless until elsif begin rescue ensure end and or not in self then yield require require_relative attr_reader attr_accessor",
    "rust": "fn match loop let mut impl where unsafe move as in use mod pub ref struct enum trait",
}
OWN |= {"typescript": OWN["javascript"], "tsx": OWN["javascript"]}
KEYWORDS = {k: COMMON | frozenset(v.split()) for k, v in OWN.items()}
CALLABLE = ("function", "method")


def _end(text: str, at: int, body: str, indent: str) -> int:
    """Index where a declaration that starts at ``at`` ends."""
    if body == "brace":
        depth, i = 0, at
        while i < len(text):
            c = text[i]
            if c in "([":
                i = matching(text, i)
            elif c == "{":
                return matching(text, i)
            elif c == ";" and depth == 0:
                return i
            i += 1
        return max(at, len(text) - 1)
    line_end = text.find("\n", at)
    line_end = len(text) if line_end < 0 else line_end
    if body == "end":
        if re.search(r"\bend\b", text[at:line_end]):
            return line_end
        m = re.compile(rf"^{indent}end\b", re.M).search(text, line_end)
        return m.end() if m else line_end
    return line_end


@dataclass
class _Found:
    at: int
    name_at: int
    end: int
    name: str
    kind: str
    owner: str | None


SCRIPTS = ("javascript", "typescript", "tsx")
#: Groups of constants and variables: the first name stands for the group.
GO_GROUP = re.compile(r"^(?P<key>const|var)\s*\(\s*(?P<name>[A-Za-z_]\w*)", re.M)


def declarations(text: str, language: str) -> list[_Found]:
    out: dict[int, _Found] = {}
    if language == "go":
        for m in GO_GROUP.finditer(text):
            out[m.start("name")] = _Found(m.start(), m.start("name"), matching(text, text.index("(", m.start())), m["name"], "constant" if m["key"] == "const" else "variable", None)
    for pattern, kind, body in COMPILED[language]:
        for m in pattern.finditer(text):
            groups = m.groupdict()
            which = "name" if groups.get("name") else "name2"
            name = groups.get(which)
            if not name or name in KEYWORDS[language] and name != "default":
                continue
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            line_start = text.rfind("\n", 0, at) + 1
            indent = re.match(r"[ \t]*", text[line_start:])[0]
            if m.start(which) in out:
                continue
            found = kind or TYPE_KINDS.get(groups["key"], "class")
            end = _end(text, m.end(which) if body == "brace" else at, body, indent)
            out[m.start(which)] = _Found(at, m.start(which), end, name.split("::")[-1], found, groups.get("owner") or ("::".join(name.split("::")[:-1]) or None))
    return sorted(out.values(), key=lambda f: (f.at, -f.end))


def _symbols(text: str, found: list[_Found], plain: bool = True) -> tuple[list[Symbol], list[tuple[int, int, str]]]:
    """Symbols with qualified names, and (start, end, qualified name) of what can call."""
    symbols, spans, scope = [], [], []
    for f in found:
        while scope and scope[-1][0] < f.at:
            scope.pop()
        owner = [s for _, s, _ in scope]
        in_type = bool(scope) and scope[-1][2]
        if f.owner:
            owner = f.owner.replace("::", ".").split(".")
        qualified = ".".join([*owner, f.name])
        if f.kind in ("class", "struct", "interface", "impl"):
            scope.append((f.end, f.name, True))
            if f.kind != "impl":
                symbols.append(Symbol(f.name, qualified, f.kind, line_of(text, f.at), line_of(text, f.end)))
            continue
        kind = "method" if plain and f.kind == "function" and (in_type or f.owner) else f.kind
        symbols.append(Symbol(f.name, qualified, kind, line_of(text, f.at), line_of(text, f.end)))
        if kind in CALLABLE:
            spans.append((f.at, f.end, qualified))
    return symbols, spans


#: The end of a call that a member follows.
CHAINED = re.compile(r"\)\s*(?:\?\.|\.|->|\?->)\s*\Z")


def closing(text: str) -> dict[int, int]:
    """Opening parenthesis of each closing one."""
    stack, out = [], {}
    for i, c in enumerate(text):
        if c == "(":
            stack.append(i)
        elif c == ")" and stack:
            out[i] = stack.pop()
    return out


_CHAIN = rf"{ID}[?!]?(?:\s*(?:\?\.|\.|::|->|\?->)\s*(?:{ID}|<[^<>()]*>)|\[[^\[\]()]*\])*"
CALL = re.compile(rf"(?<![\w$@#])(?:new\s+)?(?P<callee>\$?{_CHAIN})\s*(?P<bang>!)?(?:\?\.)?(?:<[\w\s,.<>\[\]?]*>)?\s*\(")
RUBY_CALL = re.compile(r"(?<![\w.:@$])(?P<callee>(?:[A-Za-z_]\w*(?:\.|::))+[a-z_]\w*[?!]?|(?:puts|raise|attr_reader|attr_accessor|include|extend))(?=[\s(]|$)")
BASH_CALL = re.compile(rf"(?:^|[;&|({{`]|\$\(|\b(?:then|do|else|if|while|until|!)\s)[ \t]*(?P<callee>{ID}(?:-\w+)*)(?=[\s;&|)]|$)", re.M)
BASH_WORDS = frozenset("if then else elif fi for while until do done case esac function in select return local export declare readonly set unset shift break continue exit trap true false eval exec source".split())


def _calls(text: str, language: str, found: list[_Found], spans: list[tuple[int, int, str]], walked: script.Script | None = None) -> list[Call]:
    declared = {f.name_at for f in found if walked is None or f.kind != "variable"}
    if walked:  # a declared name that is followed by its parameters is no call
        declared = {f.name_at for f in found if f.kind == "method"} | {m.start("name") for m in script._FUNCTION.finditer(text)} | walked.signatures
    # Members of interfaces are declared there, not called; Java and C# may have bodies in them.
    interfaces = [(f.at, f.end) for f in found if f.kind == "interface"] if walked or language == "go" else []
    patterns = [CALL] if language != "bash" else [BASH_CALL]
    if language == "ruby":
        patterns.append(RUBY_CALL)
    out, seen, opened = [], set(), []
    closes = closing(text)
    called: dict[int, str] = {}  # callee by its opening parenthesis
    for pattern in patterns:
        for m in pattern.finditer(text):
            at = m.start("callee")
            callee = dotted(m["callee"]).lstrip("$").replace(".$", ".")
            callee = callee if language == "ruby" else callee.rstrip("!?")
            if at in declared or at in seen or not callee or any(a < at < z for a, z in interfaces):
                continue
            earlier = CHAINED.search(text, max(0, at - 100), at) if language not in ("bash", "ruby") else None
            if earlier and closes.get(earlier.start()) in called:  # a member of what another call gives
                callee = f"{called[closes[earlier.start()]]}.{callee}"
            head = callee.split(".")[0]
            if language == "bash" and callee in BASH_WORDS or callee in KEYWORDS[language] and callee != "super":
                continue
            if head in ("return", "await", "throw", "new", "else", "case"):
                continue
            if walked is None and any(at == f.name_at or f.at <= at < f.name_at for f in found if f.kind in CALLABLE and f.at <= at <= f.name_at):
                continue
            seen.add(at)
            called[m.end() - 1] = callee
            around = [s for s in spans if s[0] <= at <= s[1]]
            caller = max(around, key=lambda s: s[0])[2] if around else MODULE
            out.append(Call(caller, callee, line_of(text, at), at - text.rfind("\n", 0, at)))
            opened.append((at, m.end() - 1, callee))
    if walked:
        callbacks = walked.callback_of(opened)
        for call, (at, _, _) in zip(out, opened):
            call.caller = callbacks.get(at, call.caller)
    return sorted(out, key=lambda c: (c.line, c.column))


# --- dependencies ------------------------------------------------------------------------


def _relations(text: str, language: str, line) -> list[Dependency]:
    """Base types of declared types."""
    out = []
    if language in ("java", "javascript", "typescript", "tsx", "php"):
        for m in re.finditer(rf"\b(?:class|interface)\s+({ID})[^{{;]*?\{{", text):
            for part in re.findall(r"\b(?:extends|implements)\s+(.*?)(?=\bextends\b|\bimplements\b|\{)", m[0], re.S):
                out += [Dependency(strip_generics(t), "base_type", line(m.start()), None, m[1]) for t in split_top(part)]
    elif language in ("csharp", "cpp"):
        for m in re.finditer(rf"\b(?:class|struct|interface|record)\s+({ID})(?:<[^{{:]*>)?\s*:\s*([^{{;]+?)(?:\bwhere\b[^{{]*)?\{{", text):
            for t in split_top(m[2]):
                t = strip_generics(re.sub(r"^(?:public|private|protected|virtual)\s+", "", t))
                out.append(Dependency(t.replace("::", "."), "base_type", line(m.start()), None, m[1]))
    elif language == "ruby":
        for m in re.finditer(r"^[ \t]*class\s+([\w:]+)\s*<\s*([\w:]+)", text, re.M):
            out.append(Dependency(m[2], "base_type", line(m.start()), None, m[1]))
    elif language == "rust":
        for m in re.finditer(rf"\bimpl\b(?:\s*<[^{{]*?>)?\s+([\w:]+)(?:<[^{{]*?>)?\s+for\s+({ID})", text):
            out.append(Dependency(m[1].split("::")[-1], "base_type", line(m.start()), None, m[2]))
    return out


def rust_use_tree(tree: str, prefix: str = "") -> list[tuple[str, str | None]]:
    """(path, alias) of every leaf of a use tree; '*' leaves keep their star."""
    tree = tree.strip()
    m = re.match(r"(.*?)\{(.*)\}$", tree, re.S)
    if m:
        head = prefix + m[1]
        return [leaf for part in split_top(m[2]) for leaf in rust_use_tree(part, head)]
    path, _, alias = tree.partition(" as ")
    path = prefix + path.strip()
    if path.endswith("::self"):
        path = path[: -len("::self")]
    return [(path, alias.strip() or None)]


def php_uses(target: str) -> list[tuple[str, str | None]]:
    """(name, alias) of a use statement; groups are opened, backslashes stay."""
    target = re.sub(r"^(?:function|const)\s+", "", target.strip())
    m = re.match(r"(.*?)\{(.*)\}$", target, re.S)
    parts = [m[1].strip() + p for p in split_top(m[2])] if m else split_top(target)
    out = []
    for p in parts:
        name, alias = (re.split(r"\s+as\s+", p, maxsplit=1, flags=re.I) + [None])[:2]
        out.append((name.strip().lstrip("\\"), alias.strip() if alias else None))
    return out


def _named(parts: str) -> list[tuple[str, str]]:
    """(imported, local) of a list in braces."""
    out = []
    for p in split_top(parts):
        p = re.sub(r"^type\s+", "", p)
        a, b = (re.split(r"\s+as\s+|\s*:\s*", p, maxsplit=1) + [None])[:2]
        out.append((a.strip(), (b or a).split("=")[0].strip()))
    return out


def javascript_dependencies(text: str, line) -> list[Dependency]:
    out: list[Dependency] = []
    bindings: dict[str, str] = {}
    for m in re.finditer(rf"\b(?:const|let|var)\s+({ID})\s*(?::[^=]+)?=\s*([^;\n]+)", text):
        value = string_value(m[2], bindings)
        if value is not None:
            bindings[m[1]] = value
    for m in re.finditer(r"""^[ \t]*import\s+(?:type\s+)?(?:(?P<what>[^'"`;]*?)\s+from\s+)?(['"])(?P<to>[^'"\n]+)\2""", text, re.M):
        at, what, to = line(m.start()), (m["what"] or "").strip(), m["to"]
        out.append(Dependency(to, "import", at))
        named = re.search(r"\{(.*?)\}", what, re.S)
        rest = re.sub(r"\{.*?\}", "", what, flags=re.S)
        for part in split_top(rest):
            star = re.match(rf"\*\s+as\s+({ID})", part)
            out.append(Dependency(to, "import_namespace" if star else "import_alias", at, star[1] if star else part, "*" if star else "default"))
        for imported, local in _named(named[1]) if named else []:
            out.append(Dependency(to, "import_alias", at, local, imported))
    for m in re.finditer(r"""^[ \t]*export\s+(?:type\s+)?(?P<what>\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+(['"])(?P<to>[^'"\n]+)\2""", text, re.M):
        at, what, to = line(m.start()), m["what"], m["to"]
        out.append(Dependency(to, "import", at))
        star = re.match(r"\*(?:\s+as\s+(\w+))?", what)
        if star:
            out.append(Dependency(to, "export_namespace", at, star[1], "*"))
        else:
            out += [Dependency(to, "export_alias", at, local, imported) for imported, local in _named(what[1:-1])]
    pattern = rf"(?:(?:const|let|var)\s+(?P<to>{ID}|\{{[^}}]*\}})\s*=\s*)?(?:await\s+)?\b(?P<key>require|import)\s*\("
    for m in re.finditer(pattern, text):
        end = matching(text, m.end() - 1)
        target = string_value(text[m.end() : end], bindings)
        if target is None:
            continue
        at, alias = line(m.start("key")), m["to"]
        out.append(Dependency(target, m["key"], at))
        if alias and alias.startswith("{"):
            out += [Dependency(target, "import_alias", at, local, imported) for imported, local in _named(alias[1:-1])]
        elif alias:
            out.append(Dependency(target, "import_namespace", at, alias, "*"))
    return out


def dependencies(text: str, language: str) -> list[Dependency]:
    """Imports, includes, uses and type relations of ``text`` with its comments blanked."""
    line = lambda at: line_of(text, at)
    out: list[Dependency] = []
    add = lambda m, kind, target, alias=None, symbol=None: out.append(Dependency(target, kind, line(m.start(0) + len(m[0]) - len(m[0].lstrip())), alias, symbol))
    each = lambda p: re.finditer(p, text, re.M)
    if language == "bash":
        for m in each(r"(?:^|[;&|]|\bthen\b|\bdo\b)[ \t]*(?:source|\.)[ \t]+(['\"]?)([^\s'\";&|$`]+)\1"):
            add(m, "source", m[2])
    elif language == "go":
        for m in each(r"^import\s+(?:\(([^)]*)\)|([^\n(]+))"):
            for spec in re.finditer(r'(?:([\w.]+)[ \t]+)?"([^"\n]+)"', m[1] or m[2]):
                at = (m.start(1) if m[1] else m.start(2)) + spec.start()
                out.append(Dependency(spec[2], "import", line(at), spec[1] or spec[2].split("/")[-1]))
        for m in each(rf"^package\s+({ID})"):
            add(m, "package", m[1])
    elif language == "java":
        for m in each(r"^[ \t]*package\s+([\w.]+)\s*;"):
            add(m, "package", m[1])
        for m in each(r"^[ \t]*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;"):
            last = m[2].split(".")[-1]
            # Static imports carry no alias: they match by bare name only.
            alias = None if m[1] or last == "*" else last
            add(m, "import_static" if m[1] else "import", m[2], alias, alias)
    elif language in ("c", "cpp"):
        for m in each(r'^[ \t]*#[ \t]*include[ \t]*(?:"([^"\n]+)"|(<[^>\n]+>))'):
            add(m, "include", m[1] or m[2])
    elif language == "csharp":
        blanked = mask(text, language)
        types = [(m.end() - 1, matching(blanked, m.end() - 1), m[1]) for m in re.finditer(rf"\b(?:class|struct|record|interface)\s+({ID})[^;{{]*\{{", blanked)]
        for m in each(r"^[ \t]*(?:global\s+)?using\s+(static\s+)?(?:(\w+)\s*=\s*)?([\w.]+(?:<[^;]*>)?)\s*;"):
            kind = "using_static" if m[1] else "using_alias" if m[2] else "using"
            add(m, kind, strip_generics(m[3]), m[2])
        for m in each(r"^[ \t]*namespace\s+([\w.]+)"):
            add(m, "namespace", m[1])
        for m in each(rf"(?:^|(?<=[{{;}}]))[ \t]*{_MODS}({_CS_TYPE})\s+({ID})\s*\{{\s*(?:get|set|init)\b"):
            around = [t for t in types if t[0] < m.start() < t[1]]
            if around:
                add(m, "property_type", element_type(m[1]), m[2], max(around)[2])
        for m in each(rf"\bstatic\s+[\w<>\[\],.?]+\s+({ID})\s*(?:<[^>]*>)?\(\s*this\s+([\w<>\[\],.?]+)\s+\w+"):
            add(m, "extension_method", strip_generics(m[2]), m[1], m[1])
        for m in each(rf"\b(?:var\s+({ID})\s*=\s*new\s+([\w.]+)(?:<[^>]*>)?\s*[({{]|([A-Z][\w.]*)(?:<[^>;()]*>)?\??\s+({ID})\s*=\s*)"):
            add(m, "type_binding", strip_generics(m[2] or m[3]), m[1] or m[4], "*")
    elif language == "php":
        for m in each(r"^[ \t]*use\s+([^;()]+);"):
            for name, alias in php_uses(m[1]):
                add(m, "use", name, alias or name.split("\\")[-1], name.split("\\")[-1])
        for m in each(r"^[ \t]*namespace\s+([\w\\]+)\s*[;{]"):
            add(m, "namespace", m[1])
    elif language == "ruby":
        for m in each(r"^[ \t]*(require|require_relative)[ \t(]+(['\"])([^'\"\n#]+)\2"):
            name = m[3].split("/")[-1]
            alias = "".join(p[:1].upper() + p[1:] for p in name.removesuffix(".rb").split("_")) if m[1] == "require_relative" else None
            add(m, m[1], m[3], alias, "*" if alias else None)
    elif language == "rust":
        for m in each(r"^[ \t]*(pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"):
            for path, alias in rust_use_tree(re.sub(r"\s+", " ", m[2])):
                star = path.endswith("::*")
                last = path.split("::")[-1]
                add(m, "rust_reexport" if m[1] else "use", path.removesuffix("::*"), None if star else alias or last, "*" if star else last)
        for m in each(rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+({ID})\s*;"):
            add(m, "mod", m[1], m[1], "*")
    elif language in ("javascript", "typescript", "tsx"):
        out += javascript_dependencies(text, line)
    return sorted(out + _relations(text, language, line), key=lambda d: d.line)


# C# types that wrap one value or many: fixed values.
WRAPPERS = ("Task", "ValueTask", "Lazy", "Nullable", "List", "IList", "IEnumerable", "ICollection", "IReadOnlyList", "IReadOnlyCollection", "HashSet", "ISet", "Queue", "Stack")
DICTIONARIES = ("Dictionary", "IDictionary", "IReadOnlyDictionary", "ConcurrentDictionary", "SortedDictionary")


def element_type(name: str) -> str:
    """The type inside wrappers and collections; of dictionaries the value type."""
    name = name.strip().rstrip("?")
    name = re.sub(r"(\[\s*,*\s*\])+$", "", name)
    m = re.fullmatch(r"([\w.]+)<(.*)>", name, re.S)
    if m:
        head, args = m[1].split(".")[-1], split_top(m[2])
        if head in WRAPPERS and len(args) == 1 or head in DICTIONARIES and len(args) == 2:
            return element_type(args[-1])
    return strip_generics(name)


def rule_extract(text: str, language: str) -> Extract:
    masked = mask(text, language)
    walked = script.Script(masked, text) if language in SCRIPTS else None
    found = [_Found(x.at, x.at, x.end, x.name, x.kind, None) for x in walked.symbols()] if walked else declarations(masked, language)
    symbols, spans = _symbols(masked, found, plain=walked is None)
    return Extract(symbols, dependencies(comments_blanked(text, language), language), _calls(masked, language, found, spans, walked))


def extract(text: str, language: str) -> Extract:
    """Everything of one file. Python that does not parse falls back to no rows with an error."""
    return python_extract(text) if language == "python" else rule_extract(text, language)


def same_file_callee(callee: str, symbols: list[Symbol], language: str) -> bool:
    """The callee is a callable of its own file, by name or by its last part.

    Plain JavaScript and TypeScript files do not take their own names first; TSX files do.
    """
    if language in ("javascript", "typescript"):
        return False
    last = callee.split(".")[-1]
    return any(s.kind in CALLABLE and (s.qualified_name == callee or s.name == callee or callee.split(".")[0] in ("self", "this") and s.name == last) for s in symbols)
