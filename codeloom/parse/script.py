"""Symbols and callback callers of JavaScript and TypeScript, from masked text.

Masked text has balanced brackets and no strings or comments, so declarations are read
by walking it: the end of an expression is where its brackets are closed and no operator
carries it on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

IDENT = r"[A-Za-z_$][\w$]*"
_WORD = re.compile(IDENT)
_DECLARE = re.compile(r"(?<![\w$.])(?:const|let|var)\s+(?=[\w$\[{])")
_FUNCTION = re.compile(rf"(?<![\w$.])(?:async\s+)?function\s+(?P<name>{IDENT})\s*(?=[<(])")
_ANONYMOUS = re.compile(rf"(?<![\w$.])(?:async\s+)?function\s*\*?\s*(?:{IDENT}\s*)?(?=[<(])")
_TYPE = re.compile(rf"(?<![\w$.])(?P<key>class|interface)\s+(?!extends\b|implements\b)(?P<name>{IDENT})[^;{{(]*(?:\([^()]*\)[^;{{(]*)*\{{")
_CLASS_BODY = re.compile(rf"(?<![\w$.])class\b(?:\s+{IDENT})?[^;{{]*\{{")
_DEFAULT = re.compile(r"(?<![\w$.])export\s+default\b")
_ASSIGN = re.compile(rf"(?P<left>{IDENT}(?:\s*\.\s*{IDENT}|\[[^\[\]\n]*\])*)\s*=(?![=>])")
_MEMBER = re.compile(rf"\s*(?:(?:public|private|protected|static|readonly|abstract|override|declare|async|get|set|accessor)\s+(?=[\w$#\[\"'*]))*\*?\s*(?P<key>#?{IDENT}|\"[^\"\n]*\"|'[^'\n]*')\s*(?P<sep>[?!]?\s*[:(<=;]|(?=\n|\}}|$))")
_ARROW = re.compile(r"=>")
#: Characters after which an expression goes on over a line's end, and before which it does.
_CARRY, _CARRIED = "=+-*/%&|^!~?:<>(,[{.", ".?:=+*/%&|^<>,)]}"


@dataclass
class Item:
    at: int
    end: int
    name: str
    kind: str


class Script:
    def __init__(self, masked: str, text: str):
        self.t, self.text = masked, text
        self.pairs: dict[int, int] = {}
        stack: list[int] = []
        for i, c in enumerate(masked):
            if c in "([{":
                stack.append(i)
            elif c in ")]}" and stack:
                self.pairs[stack.pop()] = i
        for i in stack:
            self.pairs[i] = len(masked) - 1
        self.opens = {z: a for a, z in self.pairs.items()}
        self.signatures: set[int] = set()  # places of methods without a body

    # --- walking ---------------------------------------------------------------------

    def skip(self, i: int) -> int:
        while i < len(self.t) and self.t[i].isspace():
            i += 1
        return i

    def before(self, i: int) -> int:
        """Index of the last character before ``i`` that is no space, -1 if there is none."""
        i -= 1
        while i >= 0 and self.t[i].isspace():
            i -= 1
        return i

    def expression_end(self, i: int) -> int:
        """Index after the expression that begins at ``i``: a separator, a closing bracket or a line's end."""
        t = self.t
        while i < len(t):
            c = t[i]
            if c in "([{":
                i = self.pairs[i] + 1
                continue
            if c in ",;)]}":
                return i
            if c == "\n":
                last, following = self.before(i), self.skip(i)
                carried = t[last] in _CARRY and not (t[last] in "+-" and t[last - 1] == t[last]) or following < len(t) and t[following] in _CARRIED
                if not carried:
                    return i
            i += 1
        return len(t)

    def parts(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """Ranges between the commas of [start, end) outside of brackets."""
        i = at = start
        while i < end:
            if self.t[i] in "([{":
                i = self.pairs[i]
            elif self.t[i] == ",":
                yield at, i
                at = i + 1
            i += 1
        if self.t[at:end].strip():
            yield at, end

    def equals(self, start: int, end: int) -> int:
        """Index of the '=' of a default or value in [start, end) outside of brackets, -1 without one."""
        i = start
        while i < end:
            c = self.t[i]
            if c in "([{":
                i = self.pairs[i]
            elif c == "=" and self.t[i + 1 : i + 2] not in ("=", ">") and self.t[i - 1] not in "=!<>":
                return i
            i += 1
        return -1

    def is_function(self, start: int, end: int) -> bool:
        value = self.t[start:end].strip()
        return value.startswith(("function", "async ", "async(")) or "=>" in value

    def key(self, m: re.Match) -> str | None:
        """Name of a member; a quoted one if it is a plain name."""
        raw = m["key"]
        if raw[0] in "\"'":
            raw = self.text[m.start("key") + 1 : m.end("key") - 1]
        return raw if _WORD.fullmatch(raw.lstrip("#")) else None

    # --- symbols ---------------------------------------------------------------------

    def symbols(self) -> list[Item]:
        out = [*self.types(), *self.functions(), *self.declared(), *self.assigned(), *self.class_members()]
        for i, c in enumerate(self.t):
            if c == "{":
                p = self.before(i)
                if p >= 0 and (self.t[p] in "(,[?" or re.search(r"(?<![\w$.])(?:return|default)$", self.t[max(0, p - 8) : p + 1])):
                    out += self.object_members(i, None)
        best: dict[tuple[int, str], Item] = {}
        for x in out:  # an object may be met twice, with and without an owner
            best.setdefault((x.at, x.name.rpartition(".")[2]), x)
        return sorted(best.values(), key=lambda x: (x.at, -x.end))

    def types(self) -> Iterator[Item]:
        for m in _TYPE.finditer(self.t):
            yield Item(m.start(), self.pairs[m.end() - 1], m["name"], m["key"])
        for m in _DEFAULT.finditer(self.t):
            at = self.skip(m.end())
            body = _FUNCTION.match(self.t, at) or _ANONYMOUS.match(self.t, at) or _CLASS_BODY.match(self.t, at)
            yield Item(m.start(), self.body_end(body.end() if self.t[body.end() - 1] != "{" else body.end() - 1) if body else self.expression_end(at), "default", "function")

    def body_end(self, i: int) -> int:
        """Index of the brace that closes the body of a function whose parameters begin at ``i``."""
        while i < len(self.t):
            c = self.t[i]
            if c == "{":
                p = self.before(i)
                if self.t[p] not in ":|&<,":  # an object type of the result is no body
                    return self.pairs[i]
                i = self.pairs[i]
            elif c in "([":
                i = self.pairs[i]
            elif c in ";}":
                return i
            i += 1
        return len(self.t) - 1

    def functions(self) -> Iterator[Item]:
        for m in _FUNCTION.finditer(self.t):
            yield Item(m.start(), self.body_end(m.end()), m["name"], "function")

    def declared(self) -> Iterator[Item]:
        """Variables of const, let and var, destructured ones included; members of objects that they hold."""
        for m in _DECLARE.finditer(self.t):
            i = m.end()
            while True:
                i = self.skip(i)
                start = i
                if i < len(self.t) and self.t[i] in "{[":
                    i = self.pairs[i] + 1
                else:
                    word = _WORD.match(self.t, i)
                    if not word:
                        break
                    i = word.end()
                if re.match(r"\s+(?:of|in)\b", self.t[i : i + 40]):
                    break
                end = self.expression_end(i)
                eq = self.equals(i, end)
                if eq >= 0:
                    end = self.expression_end(self.skip(eq + 1))
                kind = "function" if eq >= 0 and self.is_function(eq + 1, end) else "variable"
                if self.t[start] in "{[":
                    for name, k in self.bindings(start, "variable"):
                        yield Item(start, end - 1, name, k)
                else:
                    name = _WORD.match(self.t, start)[0]
                    yield Item(start, end - 1, name, kind)
                    value = self.skip(eq + 1) if eq >= 0 else -1
                    if value >= 0 and value < len(self.t) and self.t[value] == "{":
                        yield from self.object_members(value, name)
                if end >= len(self.t) or self.t[end] != ",":
                    break
                i = end + 1

    def bindings(self, at: int, kind: str) -> Iterator[tuple[str, str]]:
        """(name, kind) that the pattern at ``at`` binds; a default that is a function makes a function."""
        is_object = self.t[at] == "{"
        for a, z in self.parts(at + 1, self.pairs[at]):
            a = self.skip(a)
            if self.t.startswith("...", a):
                a = self.skip(a + 3)
            eq = self.equals(a, z)
            own = "function" if eq >= 0 and self.is_function(eq + 1, z) else kind
            stop = eq if eq >= 0 else z
            if is_object:
                colon = self.colon(a, stop)
                a = self.skip(colon + 1) if colon >= 0 else a
            if a < z and self.t[a] in "{[":
                yield from self.bindings(a, own)
            else:
                word = _WORD.match(self.t, a)
                if word and word.end() <= z:
                    yield word[0], own

    def colon(self, start: int, end: int) -> int:
        i = start
        while i < end:
            if self.t[i] in "([{":
                i = self.pairs[i]
            elif self.t[i] == ":":
                return i
            i += 1
        return -1

    def object_members(self, at: int, owner: str | None) -> Iterator[Item]:
        """Methods and function values of the object literal at ``at``, named after its ``owner``."""
        for a, z in self.parts(at + 1, self.pairs[at]):
            m = _MEMBER.match(self.t, a, z)
            name = self.key(m) if m else None
            if not name:
                continue
            full, sep = f"{owner}.{name}" if owner else name, m["sep"].strip()
            if sep == "(" or sep == "<":
                yield Item(m.start("key"), self.body_end(m.end() - 1), full, "method")
            elif sep == ":":
                value = self.skip(m.end())
                if value < z and self.t[value] == "{":
                    yield from self.object_members(value, full if owner else None)
                if self.is_function(value, z) and self.t[value : value + 1] != "{":
                    yield Item(m.start("key"), z - 1, full, "method")

    def class_members(self) -> Iterator[Item]:
        """Methods and fields of class bodies."""
        for c in _CLASS_BODY.finditer(self.t):
            open_at = c.end() - 1
            i, close = open_at + 1, self.pairs[open_at]
            while i < close:
                i = self.skip(i)
                if i >= close:
                    break
                if self.t[i] in ";,":
                    i += 1
                    continue
                if self.t[i] == "@":  # a decorator
                    word = re.compile(rf"@{IDENT}(?:\.{IDENT})*\s*").match(self.t, i)
                    i = word.end() if word else i + 1
                    if i < close and self.t[i] == "(":
                        i = self.pairs[i] + 1
                    continue
                m = _MEMBER.match(self.t, i, close)
                name = self.key(m) if m else None
                if not m:
                    i = self.pairs[i] + 1 if self.t[i] in "([{" else i + 1
                    continue
                sep = m["sep"].strip()[-1:]
                if sep in ("(", "<"):
                    end = self.body_end(m.end() - 1)
                    if self.t[end] != "}":
                        self.signatures.add(m.start("key"))
                    elif name:
                        yield Item(m.start("key"), end, name, "method")
                    i = end + 1
                else:
                    eq = m.end() - 1 if sep == "=" else -1
                    end = self.expression_end(m.end()) if sep else m.end()
                    if eq < 0 and sep == ":":
                        eq = self.equals(m.end(), end)
                    if eq >= 0:
                        end = self.expression_end(self.skip(eq + 1))
                    if name:
                        yield Item(m.start("key"), max(m.start("key"), min(end, close) - 1), name, "method")
                    i = max(end, m.end("key"))

    def assigned(self) -> Iterator[Item]:
        """Exports, properties and names that functions are assigned to; members of objects that are assigned."""
        bodies = [(c.end() - 1, self.pairs[c.end() - 1]) for c in _CLASS_BODY.finditer(self.t)]
        for m in _ASSIGN.finditer(self.t):
            p = self.before(m.start())
            if p >= 0 and self.t[p] not in ";{}):=&|>\n" and "\n" not in self.t[p + 1 : m.start()]:
                continue
            if p >= 0 and self.t[p] in ",.([" or re.search(r"(?<![\w$.])(?:const|let|var|type|enum)$", self.t[max(0, p - 6) : p + 1]):
                continue
            if any(a < m.start() < z and self.depth(a, m.start()) == 1 for a, z in bodies):
                continue  # a field
            value = self.skip(m.end())
            end = self.expression_end(value)
            left = re.sub(r"\s+", "", m["left"])
            function = self.is_function(value, end)
            name = self.export_name(left, value, end) or (re.sub(r"\[.*", ".<dynamic>", left) if function and re.fullmatch(rf"{IDENT}\[{IDENT}\]", left) else None)
            if name:
                yield Item(m.start(), end - 1, name, "method" if function else "variable")
            elif function and _WORD.fullmatch(left):
                yield Item(m.start(), end - 1, left, "function")
            if value < len(self.t) and self.t[value] == "{":
                owner = left if _WORD.fullmatch(left) and left != "exports" else self.export_name(left, value, value)
                yield from self.object_members(value, owner)

    def depth(self, start: int, at: int) -> int:
        """Open braces between ``start`` and ``at``; brackets that are closed in between do not count."""
        n, i = 0, start
        while i < at:
            if self.t[i] in "([{":
                if self.pairs[i] < at:
                    i = self.pairs[i]
                else:
                    n += 1
            i += 1
        return n

    def export_name(self, left: str, value: int, end: int) -> str | None:
        """Name under which an assignment to exports or to a property makes its value known."""
        if left in ("module.exports", "exports"):
            named = re.match(rf"function\s+({IDENT})", self.t[value:end]) or re.match(rf"(?!function\b)({IDENT})(?=\s|$)", self.t[value:end])
            return named[1] if named else left
        for prefix in ("module.exports.", "exports."):
            if left.startswith(prefix):
                return left if _WORD.fullmatch(left[len(prefix) :]) else None
        return left if re.fullmatch(rf"{IDENT}\.{IDENT}", left) else None

    # --- callbacks --------------------------------------------------------------------

    def anonymous(self) -> list[tuple[int, int]]:
        """(start, end) of arrow functions and function expressions."""
        out = []
        for m in _ARROW.finditer(self.t):
            p = self.before(m.start())
            start = p
            if p >= 0 and self.t[p] == ")":
                start = self.opens.get(p, p)
            else:
                while start > 0 and (self.t[start - 1].isalnum() or self.t[start - 1] in "_$"):
                    start -= 1
            body = self.skip(m.end())
            end = self.pairs[body] if body < len(self.t) and self.t[body] == "{" else self.expression_end(body) - 1
            out.append((start, end))
        for m in _ANONYMOUS.finditer(self.t):
            p = self.before(m.start())
            if p >= 0 and self.t[p] in "=(,:[!&|?+" or re.search(r"(?<![\w$.])(?:return|await|default)$", self.t[max(0, p - 8) : p + 1]):
                out.append((m.start(), self.body_end(m.end())))
        return sorted(out)

    def callback_of(self, calls: list[tuple[int, int, str]]) -> dict[int, str]:
        """For each call (start, opening parenthesis, callee) inside an anonymous function that is an argument: its callback's name."""
        functions, out = self.anonymous(), {}
        context: dict[tuple[int, int], str | None] = {}
        for a, z in functions:
            after = self.skip(z + 1)
            called = after < len(self.t) and (self.t[after] == "(" and self.t[z] == "}" or self.t[after] == ")" and self.t[self.skip(after + 1) : self.skip(after + 1) + 1] == "(")
            around = [(open_at, callee) for _, open_at, callee in calls if open_at < a and z <= self.pairs[open_at]]
            context[a, z] = None if called or not around else max(around)[1] + ".<callback>"
        for start, _, _ in calls:
            inside = [f for f in functions if f[0] <= start <= f[1]]
            for f in sorted(inside, reverse=True):
                if context[f]:
                    out[start] = context[f]
                    break
        return out
