"""Masking of comments and strings, balanced text, names of calls."""

from __future__ import annotations

import re

LINE_COMMENT = {"bash": "#", "python": "#", "ruby": "#", "php": "(?://|#(?!\\[))"}
BLOCKS = ("c", "cpp", "csharp", "go", "java", "javascript", "php", "rust", "typescript", "tsx")
OPEN, CLOSE = "([{", ")]}"


def _token_pattern(language: str) -> re.Pattern:
    parts = []
    if language in BLOCKS:
        parts.append(r"/\*.*?(?:\*/|\Z)")
    comment = LINE_COMMENT.get(language, "//")
    parts.append((r"(?:(?<=\s)|^)#[^\n]*" if language == "bash" else comment + r"[^\n]*"))
    parts.append(r'"(?:\\.|[^"\\])*(?:"|\Z)' if language not in ("csharp",) else r'@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*(?:"|$)')
    if language == "rust":
        parts.append(r"'(?:\\.[^']*|[^'\\])'")  # a character, not a lifetime
    elif language in ("c", "cpp", "csharp", "java", "go"):
        parts.append(r"'(?:\\.|[^'\\\n])*'")
    else:
        parts.append(r"'(?:\\.|[^'\\])*(?:'|\Z)")
    if language in ("javascript", "typescript", "tsx", "go"):
        parts.append(r"`(?:\\.|[^`\\])*(?:`|\Z)" if language != "go" else r"`[^`]*(?:`|\Z)")
    if language == "ruby":
        parts.append(r"^=begin.*?^=end[^\n]*")
    return re.compile("|".join(f"(?:{p})" for p in parts), re.S | re.M)


PATTERNS = {x: _token_pattern(x) for x in ("bash", "c", "cpp", "csharp", "go", "java", "javascript", "php", "python", "ruby", "rust", "typescript", "tsx")}


def mask(text: str, language: str, keep_quotes: bool = True) -> str:
    """The text with comments and the insides of strings blanked; length and newlines stay."""

    def blank(m: re.Match) -> str:
        s = m[0]
        inner = re.sub(r"[^\n]", " ", s)
        if keep_quotes and s[0] in "\"'`" and len(s) > 1:
            return s[0] + inner[1:-1] + (s[-1] if s[-1] == s[0] else inner[-1])
        return inner

    return PATTERNS[language].sub(blank, text)


def comments_blanked(text: str, language: str) -> str:
    """The text with comments blanked and strings left as they are."""
    return PATTERNS[language].sub(lambda m: m[0] if m[0][0] in "\"'`@" else re.sub(r"[^\n]", " ", m[0]), text)


def matching(text: str, at: int) -> int:
    """Index of the delimiter that closes the one at ``at`` in masked text; the last index if none does."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] in OPEN:
            depth += 1
        elif text[i] in CLOSE:
            depth -= 1
            if depth == 0:
                return i
    return len(text) - 1


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts between separators outside of brackets, angle brackets included; trimmed, empty ones dropped."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1 : i] not in ("-", "="):
            depth -= 1
        elif c == separator and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:])
    return [p.strip() for p in parts if p.strip()]


def strip_generics(name: str) -> str:
    """A type name without type arguments, array marks and nullability."""
    out, depth = "", 0
    for c in name:
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
        elif depth == 0:
            out += c
    return re.sub(r"[\[\]?&*\s]+$", "", out.strip())


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def dotted(callee: str) -> str:
    """Canonical callee: '::', '->' and '?.' are dots, type and call arguments are dropped, '[x]' is <dynamic>."""
    out, depth = "", 0
    i = 0
    s = callee.replace("?->", ".").replace("->", ".").replace("::", ".").replace("?.", ".")
    while i < len(s):
        c = s[i]
        if c in "(<":
            depth += 1
        elif c in ")>":
            depth -= 1
        elif depth == 0 and c == "[":
            end = s.find("]", i)
            out += ".<dynamic>"
            i = end if end >= 0 else len(s)
        elif depth == 0 and not c.isspace():
            out += c
        i += 1
    return re.sub(r"\.{2,}", ".", out).strip(".")


QUOTED = re.compile(r"""(['"`])((?:\\.|(?!\1).)*)\1""", re.S)


def string_value(expression: str, bindings: dict[str, str] | None = None) -> str | None:
    """Value of a static string expression: literals, names of earlier bindings, '+' and templates of those."""
    bindings = bindings or {}
    parts, value = split_top(expression.strip(), "+"), ""
    for p in parts:
        while p.startswith("(") and p.endswith(")"):
            p = p[1:-1].strip()
        m = QUOTED.fullmatch(p)
        if m and m[1] == "`":
            unknown = False

            def fill(x: re.Match) -> str:
                nonlocal unknown
                got = string_value(x[1], bindings)
                unknown |= got is None
                return got or ""

            text = re.sub(r"\$\{([^}]*)\}", fill, m[2])
            if unknown:
                return None
            value += text
        elif m:
            value += re.sub(r"\\(.)", r"\1", m[2])
        elif p in bindings:
            value += bindings[p]
        elif "+" in p and p != expression:
            inner = string_value(p, bindings)
            if inner is None:
                return None
            value += inner
        else:
            return None
    return value if parts else None
