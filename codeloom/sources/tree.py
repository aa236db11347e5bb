"""Source trees: scope, walk roots, file rows, languages, configuration.

The driver lists the top folders, executors list the rest and read the files. A file or
folder that cannot be read gives a row with an error and the scan goes on.
"""

from __future__ import annotations

import fnmatch
import os
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.names import line_count
from codeloom.operators.scratch import materialize

# Folders that are never entered, at any depth: fixed values.
PRUNED = (".git", ".codeloom", "node_modules", "target", "dist", "build", ".venv", "vendor", ".next", ".turbo")

# File extensions of the languages: fixed values.
EXTENSIONS = {
    "sh": "bash", "bash": "bash", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp",
    "cs": "csharp", "go": "go", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "php": "php", "py": "python",
    "rb": "ruby", "rs": "rust", "ts": "typescript", "tsx": "tsx",
}
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*"
META = re.compile(r"[*?\[\]{}]")


def language_of(path: Column) -> Column:
    """Language by extension; null for a path that has none of them."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    extension = F.when(F.instr(F.element_at(F.split(path, "/", -1), -1), ".") > 0, F.substring_index(path, ".", -1))
    return F.try_element_at(table, extension)


def glob_regex(pattern: str) -> str:
    """Anchored regex of a path glob: ``*`` and ``?`` stay within a part, ``**`` crosses parts, braces choose."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def clean_pattern(pattern: str) -> str:
    p = pattern.strip().replace("\\", "/")
    while p.startswith("./"):
        p = p[2:]
    return p.strip("/")


def scope_regexes(patterns: list[str]) -> list[str]:
    """Regexes of scope patterns; one without a metacharacter covers its subtree as well."""
    out = []
    for p in filter(None, map(clean_pattern, patterns)):
        out.append(glob_regex(p))
        if not META.search(p):
            out.append(glob_regex(p + "/**"))
    return out


def static_root(pattern: str) -> str:
    """Leading parts of a pattern that have no metacharacter."""
    parts = []
    for part in clean_pattern(pattern).split("/"):
        if META.search(part):
            break
        parts.append(part)
    return "/".join(parts)


def walk_roots(include: list[str]) -> list[str]:
    """Folders that hold everything the include patterns can match; nested ones left out. [''] is the whole tree."""
    roots = sorted({static_root(p) for p in include if clean_pattern(p)}, key=lambda r: (len(r), r)) or [""]
    kept: list[str] = []
    for r in roots:
        if not any(k == "" or r == k or r.startswith(k + "/") for k in kept):
            kept.append(r)
    return kept


@dataclass
class Scope:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def condition(self, path: Column) -> Column:
        """Inside the include patterns, if there are any, and outside the exclude patterns."""
        inside, outside = scope_regexes(self.include), scope_regexes(self.exclude)
        any_of = lambda rs: path.rlike("|".join(f"(?:{r})" for r in rs))
        return (any_of(inside) if inside else F.lit(True)) & (~any_of(outside) if outside else F.lit(True))

    def matches(self, path: str) -> bool:
        inside, outside = scope_regexes(self.include), scope_regexes(self.exclude)
        return (not inside or any(re.search(r, path) for r in inside)) and not any(re.search(r, path) for r in outside)


@dataclass(frozen=True)
class IgnoreRule:
    """A line of an ignore file: the folder it lies in, what it matches below, and whether it takes back."""

    folder: str
    pattern: re.Pattern
    negated: bool
    folders_only: bool


def ignore_rules(folder: str, text: str) -> list[IgnoreRule]:
    """Rules of the ignore file of ``folder``; a pattern with an inner slash is tied to the folder, others match at any depth."""
    out = []
    for raw in text.splitlines():
        line = raw.rstrip() if not raw.endswith("\\ ") else raw[:-2] + " "
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\")
        body = line.strip("/")
        if not body or not negated and raw.startswith("#"):
            continue
        tied = "/" in line.rstrip("/")
        out.append(IgnoreRule(folder, re.compile(glob_regex(body if tied else f"**/{body}")), negated, line.endswith("/")))
    return out


def is_ignored(path: str, is_folder: bool, rules: list[IgnoreRule]) -> bool:
    """The last rule that matches decides; rules of inner folders come after those of outer ones."""
    for r in reversed(rules):
        if r.folders_only and not is_folder or r.folder and not path.startswith(r.folder + "/"):
            continue
        if r.pattern.match(path[len(r.folder) + 1 :] if r.folder else path):
            return not r.negated
    return False


#: Folders that the driver finds open before it hands the rest of a walk to the executors.
FRONTIER = 1000
#: A file that was found: path, size, time in microseconds, and an error if it could not be listed.
Found = tuple[str, int | None, int | None, str | None]


@dataclass
class Walker:
    """Lists the folders of a tree. Pruned and ignored folders are not entered.

    Ignore files of all folders count, inner ones after outer ones, and a file below an
    ignored folder cannot be taken back. What cannot be listed becomes a row with an error.
    """

    root: str
    scope: Scope
    rules: dict[str, list[IgnoreRule]] = field(default_factory=dict)

    def rules_of(self, folder: str) -> list[IgnoreRule]:
        if folder not in self.rules:
            above = self.rules_of(os.path.dirname(folder)) if folder else []
            try:
                with open(os.path.join(self.root, folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                    self.rules[folder] = above + ignore_rules(folder, f.read())
            except OSError:
                self.rules[folder] = above
        return self.rules[folder]

    def is_open(self, path: str, is_folder: bool) -> bool:
        """Whether neither ``path`` nor a folder above it is ignored."""
        parts = path.split("/") if path else []
        return not any(is_ignored("/".join(parts[: n + 1]), n + 1 < len(parts) or is_folder, self.rules_of("/".join(parts[:n]))) for n in range(len(parts)))

    def file(self, path: str) -> list[Found]:
        name = os.path.basename(path)
        if "." not in name or name.rpartition(".")[2] not in EXTENSIONS or not self.scope.matches(path):
            return []
        try:
            stat = os.stat(os.path.join(self.root, path))
        except OSError as e:
            return [(path, None, None, f"walk: {e.strerror}")]
        return [(path, stat.st_size, stat.st_mtime_ns // 1000, None)]

    def folder(self, at: str) -> tuple[list[Found], list[str]]:
        """Files and folders right below ``at``."""
        own, files, inner = self.rules_of(at), [], []
        try:
            with os.scandir(os.path.join(self.root, at)) as entries:
                for e in sorted(entries, key=lambda e: e.name):
                    path = f"{at}/{e.name}" if at else e.name
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in PRUNED and not is_ignored(path, True, own):
                            inner.append(path)
                    elif not is_ignored(path, False, own):
                        files += self.file(path)
        except OSError as e:
            files.append((at, None, None, f"walk: {e.strerror}"))
        return files, inner

    def walk(self, starts: list[str], most: int | None = None) -> tuple[list[Found], list[str]]:
        """Everything below ``starts``, level by level; with ``most``, up to a level of more open folders, which are returned."""
        found: dict[str, Found] = {}
        level = []
        for start in starts:
            if os.path.isfile(os.path.join(self.root, start)):
                found |= {f[0]: f for f in (self.file(start) if self.is_open(start, False) else [])}
            elif self.is_open(start, True):
                level.append(start)
        while level and (most is None or len(level) <= most):
            below: list[str] = []
            for at in level:
                files, inner = self.folder(at)
                found |= {f[0]: f for f in files}
                below += inner
            level = below
        return [found[p] for p in sorted(found)], level


def list_tree(root: str, scope: Scope) -> list[Found]:
    """All files of known languages of a tree, listed by this process."""
    return Walker(root, scope).walk(walk_roots(scope.include))[0]


_FOUND = "path string, size long, modified long, error string"


def _mounted_files(spark: SparkSession, root: str, scope: Scope) -> DataFrame:
    """Listed and read on the executors; the driver lists the top levels only, as far as FRONTIER folders lie open.

    Spark's own reader skips names like __init__.py.
    """
    top, open_folders = Walker(root, scope).walk(walk_roots(scope.include), FRONTIER)
    names = spark.createDataFrame(top, _FOUND)
    if open_folders:

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walker = Walker(root, scope)
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_pylist([dict(zip(("path", "size", "modified", "error"), f)) for f in walker.walk([start])[0]], schema=_FOUND_ARROW)

        folders = spark.createDataFrame([(f,) for f in open_folders], "folder string").repartition(max(1, len(open_folders) // 8), "folder")
        names = materialize(names.unionByName(folders.mapInArrow(walk, _FOUND)))
    # About 16 MB or 2,000 files to a task.
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    tasks = max(1, size["n"] // 2000, size["size"] >> 24)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, errors = [], []
            for path, lost in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                content = None
                if lost is None:
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            content = f.read()
                    except OSError as e:
                        lost = f"read: {e.strerror}"
                contents.append(content)
                errors.append(lost)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=["path", "size", "modified", "content", "error"])

    return names.repartition(tasks, "path").mapInArrow(read, "path string, size long, modified long, content binary, error string")


_FOUND_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64()), ("error", pa.string())])


def _stored_files(spark: SparkSession, root: str, scope: Scope) -> DataFrame:
    """By Spark's binary reader, which passes over empty files and over names that begin with '_' or '.'."""
    roots = [f"{root}/{r}".rstrip("/") for r in walk_roots(scope.include)]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    prefix = re.sub(SCHEME, "/", root) + "/"
    path = F.substr(F.regexp_replace(F.col("path"), SCHEME, "/"), F.lit(len(prefix) + 1))
    own = raw.select(path.alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"), "content", F.lit(None).cast("string").alias("error"))
    pruned = "(^|/)(" + "|".join(re.escape(p) for p in PRUNED) + ")/"
    return own.filter(~F.col("path").rlike(pruned) & scope.condition(F.col("path")))


def read_tree(spark: SparkSession, root: str, scope: Scope | None = None) -> DataFrame:
    """(path, language, text, error, size, modified, hash, line_count) of the files of known languages.

    ``path`` is relative to ``root``. Only folders that the scope can match are listed.
    A file that cannot be read, or is not UTF-8, has an error and no text.
    """
    scope = scope or Scope()
    base = re.sub("^file:/*", "/", root).rstrip("/")
    own = _mounted_files(spark, base, scope) if "://" not in base else _stored_files(spark, base, scope)
    own = own.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isNotNull() | F.col("error").startswith("walk:"))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    error = F.coalesce("error", F.when(text.isNull(), "read: invalid UTF-8"))
    return own.select("path", "language", text.alias("text"), error.alias("error"), "size", "modified", F.sha2("content", 256).alias("hash"), line_count(text).alias("line_count"))


# --- configuration -----------------------------------------------------------------

CONFIG = "codeloom.toml"


@dataclass
class Config:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    package_conditions: list[str] = field(default_factory=lambda: ["import", "require", "node", "default"])
    test_commands: list[str] = field(default_factory=list)
    checks: list[dict] = field(default_factory=list)


def load_config(root: str) -> Config:
    """Defaults for a missing file; a ValueError for a malformed one."""
    path = os.path.join(root, CONFIG)
    if not os.path.exists(path):
        return Config()
    try:
        with open(path, "rb") as f:
            raw = tomllib.load(f)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{path}: {e}") from e
    known = Config()
    for k, v in raw.items():
        if hasattr(known, k):
            if not isinstance(v, list):
                raise ValueError(f"{path}: {k} must be a list")
            setattr(known, k, v)
    return known


def write_config(root: str, force: bool = False) -> str:
    """A sample file; refuses to replace one unless forced."""
    path = os.path.join(root, CONFIG)
    if os.path.exists(path) and not force:
        raise FileExistsError(path)
    quoted = ", ".join(f'"{c}"' for c in test_commands(os.listdir(root)))
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'include = []\nexclude = []\npackage_conditions = ["import", "require", "node", "default"]\ntest_commands = [{quoted}]\n')
    return path


def config_status(spark: SparkSession, root: str) -> DataFrame:
    """One row: exists, loaded, parse_error, configured and detected commands, and whether the former override."""
    exists, error, config = os.path.exists(os.path.join(root, CONFIG)), None, Config()
    try:
        config = load_config(root)
    except ValueError as e:
        error = str(e)
    detected = test_commands(os.listdir(root))
    row = (exists, exists and error is None, error, config.test_commands, detected, bool(config.test_commands))
    return spark.createDataFrame([row], "exists boolean, loaded boolean, parse_error string, configured array<string>, detected array<string>, overrides boolean")


# Test command of each ecosystem by a file at the root: fixed values.
TEST_COMMANDS = (
    (("Cargo.toml",), "cargo test"),
    (("package.json",), "npm test"),
    (("go.mod",), "go test ./..."),
    (("pyproject.toml", "setup.py", "pytest.ini", "tox.ini"), "pytest"),
    (("Gemfile", "Rakefile"), "bundle exec rake test"),
    (("composer.json",), "composer test"),
    (("pom.xml",), "mvn test"),
    (("build.gradle", "build.gradle.kts"), "gradle test"),
    (("*.sln", "*.csproj"), "dotnet test"),
    (("CMakeLists.txt",), "ctest"),
    (("Makefile",), "make test"),
)


def test_commands(names: list[str]) -> list[str]:
    """Commands in order of the table for the file names at a root."""
    return [command for patterns, command in TEST_COMMANDS if any(fnmatch.fnmatchcase(n, p) for p in patterns for n in names)]


test_commands.__test__ = False
