"""Scalar rules over names and paths, as column expressions.

Dotted names are matched by suffix or prefix. A LIKE join on them plans a nested
loop; the explosions below turn it into an equi-join with a bounded fan-out, the
number of dots in a name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only, as the stored LIKE rules fold."""
    return F.translate(c, UPPER, LOWER)


def dotted_suffixes(name: Column) -> Column:
    """'a.b.c' to ['a.b.c', 'b.c', 'c']; null stays null."""
    parts = F.split(name, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def dotted_prefixes(name: Column) -> Column:
    """Proper prefixes that end before a dot: 'a.b.c' to ['a', 'a.b']; empty without a dot."""
    parts = F.split(name, r"\.", -1)
    return F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    ).otherwise(F.array().cast("array<string>"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def directory_key(path: Column) -> Column:
    """Text before the first slash, '.' for a path without one."""
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.substring_index(path, "/", 1))


# Roles of paths: top folders, words in the path and endings, in the order in which they decide. Fixed values.
PATH_ROLES = (
    ("vendor", ("node_modules",), (), ()),
    ("fixture", (), ("fixture",), ()),
    ("test", ("test", "tests"), (), ("_test", "_tests")),
    ("example", ("examples",), (), ()),
    ("docs", ("docs",), (), ()),
)


def _below(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder + "/")


def path_role(path: Column) -> Column:
    """vendor, fixture, test, example, docs or source; the first rule that fits decides."""
    p, found = ascii_lower(path), F.lit("source")
    for role, folders, words, endings in reversed(PATH_ROLES):
        fits = F.lit(False)
        for condition in (*(_below(p, x) for x in folders), *(p.contains(x) for x in words), *(p.endswith(x) for x in endings)):
            fits = fits | condition
        found = F.when(fits, role).otherwise(found)
    return found


def is_local(resolved: Column) -> Column:
    """Resolved to a file of the repository itself, not to an installed package."""
    return resolved.isNotNull() & ~resolved.startswith("node_modules/")


def line_count(text: Column) -> Column:
    """Lines as a line iterator counts them: a final newline adds none, empty text has none."""
    n = F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0)
    return F.when(text.isNull() | (text == ""), 0).otherwise(n).cast("long")


def floor_percent(part: Column, whole: Column) -> Column:
    """Percentage floored to two decimals; null for an empty whole."""
    return F.when(whole != 0, F.floor(part * 10000 / whole) / 100)


def normalize_path(path: Column) -> Column:
    """Drop empty and '.' parts, let '..' take back the part before it."""
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    zero = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, zero, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(kept, "/")


# Entrypoint conventions of files: score, reason, and what the path must be like; of several the first counts. Fixed values.
# "stem": the file name up to its first dot is one of these; "name": the whole file name is; "under": a folder of the path
# is the first and the stem one of the others; "path": the path is or ends with this; "part": the path has the first or the
# stem is the second; "ending": the file name ends so.
FILE_SIGNALS = (
    (100, "conventional main file", "stem", ("main",)),
    (82, "Next.js app router entrypoint", "under", ("app", "page", "layout", "route")),
    (82, "Next.js pages bootstrap entrypoint", "under", ("pages", "_app", "_document")),
    (82, "Rails route entrypoint", "path", ("config/routes.rb",)),
    (79, "Python web framework entrypoint", "name", ("manage.py", "asgi.py", "wsgi.py", "urls.py")),
    (79, "C# web application entrypoint", "name", ("program.cs", "startup.cs")),
    (90, "Rust library root", "name", ("lib.rs",)),
    (85, "Rust module root", "name", ("mod.rs",)),
    (80, "conventional index file", "stem", ("index",)),
    (75, "conventional app file", "stem", ("app",)),
    (70, "server entrypoint naming", "part", ("/server.", "server")),
    (65, "CLI entrypoint naming", "part", ("/cli.", "cli")),
    (62, "Java application entrypoint naming", "ending", ("application.java",)),
)
# Entry-like names of symbols: score, what is said of them, and whether the name is added. Fixed values.
SYMBOL_SIGNALS = (
    (110, "entry symbol named main", False, ("main",)),
    (88, "entry-like symbol named ", True, ("run", "start")),
    (78, "service entry-like symbol named ", True, ("server", "handler")),
)
#: Score that counts as certain.
CERTAIN = 110
# What is taken off for a folder, and for a role of the path. Fixed values.
LOW_FOLDER, LOW_ROLES = ("scripts", -40), (("docs", "test", "fixture", "vendor"), -60)


def _like(path: Column, how: str, names: tuple[str, ...]) -> Column:
    p = ascii_lower(path)
    b = basename(p)
    stem = lambda *own: F.substring_index(b, ".", 1).isin(*own) & (F.instr(b, ".") > 0)
    if how == "stem":
        return stem(*names)
    if how == "name":
        return b.isin(*names)
    if how == "under":
        return (p.startswith(f"{names[0]}/") | p.contains(f"/{names[0]}/")) & stem(*names[1:])
    if how == "path":
        return (p == names[0]) | p.endswith("/" + names[0])
    if how == "part":
        return p.contains(names[0]) | stem(names[1])
    return b.endswith(names[0])


def file_entrypoint(path: Column) -> Column:
    """struct(score, reason) of the first convention that a path follows; null if none."""
    found = F.lit(None).cast("struct<score:int,reason:string>")
    for score, reason, how, names in reversed(FILE_SIGNALS):
        found = F.when(_like(path, how, names), F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))).otherwise(found)
    return found


def symbol_entrypoint(name: Column) -> Column:
    """struct(score, reason) of an entry-like symbol name; null if it is none."""
    n, found = ascii_lower(name), F.lit(None).cast("struct<score:int,reason:string>")
    for score, said, named, names in SYMBOL_SIGNALS:
        reason = F.concat(F.lit(said), name) if named else F.lit(said)
        found = F.when(n.isin(*names), F.struct(F.lit(score).alias("score"), reason.alias("reason"))).otherwise(found)
    return found


def entrypoint_confidence(score: Column) -> Column:
    return F.round(F.least(score, F.lit(CERTAIN)) / CERTAIN, 2)


def entrypoint_priority(path: Column) -> Column:
    p = ascii_lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.when(_below(p, LOW_FOLDER[0]), LOW_FOLDER[1]).when(path_role(path).isin(*LOW_ROLES[0]), LOW_ROLES[1]).otherwise(0)
