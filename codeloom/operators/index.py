"""The index of a source tree: files, symbols, dependencies, calls.

One pass of Arrow batches extracts all three child tables of a file; what follows is
joins. Only metadata files (modules, packages, path configurations) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import arms, incremental
from codeloom.operators.scratch import materialize, materialize_bounded
from codeloom.parse import paths
from codeloom.parse.extract import SAME_FILE, UNRESOLVED, extract, same_file_callee

SYMBOL = "struct<name:string,qualified_name:string,kind:string,start_line:bigint,end_line:bigint>"
DEPENDENCY = "struct<target:string,kind:string,line:bigint,local_alias:string,imported_symbol:string>"
CALL = "struct<caller:string,callee:string,line:bigint,column:bigint,confidence:double,own:boolean>"
SCHEMA = f"path string, language string, symbols array<{SYMBOL}>, dependencies array<{DEPENDENCY}>, calls array<{CALL}>, extractor string, error string"
METADATA = r"(^|/)(go\.mod|go\.work|package\.json|tsconfig\.json|jsconfig\.json|pnpm-workspace\.yaml)$"
#: Metadata files, and their characters in all, that the driver takes and sends to the executors; a tree with more is an error, not a silent cut.
MAX_METADATA, MAX_METADATA_CHARS = 50_000, 256 << 20


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            try:
                e = extract(text or "", language)
            except (SyntaxError, ValueError, RecursionError) as x:
                rows.append({"path": path, "language": language, "symbols": [], "dependencies": [], "calls": [], "extractor": None, "error": f"parse: {x}"})
                continue
            calls = []
            for c in e.calls:
                own = same_file_callee(c.callee, e.symbols, language)
                calls.append(vars(c) | {"own": own, "confidence": SAME_FILE if own else UNRESOLVED})
            rows.append(
                {"path": path, "language": language, "symbols": [vars(s) for s in e.symbols], "dependencies": [vars(d) for d in e.dependencies], "calls": calls, "extractor": e.extractor, "error": None}
            )
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _struct(ddl: str) -> pa.DataType:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.list_(pa.struct([(n, kinds[t]) for n, t in (f.split(":") for f in ddl[7:-1].split(","))]))


_ARROW = pa.schema(
    [("path", pa.string()), ("language", pa.string()), ("symbols", _struct(SYMBOL)), ("dependencies", _struct(DEPENDENCY)), ("calls", _struct(CALL)), ("extractor", pa.string()), ("error", pa.string())]
)


def extract_files(files: DataFrame) -> DataFrame:
    """Extraction of each row of ``files`` (path, language, text); a file that fails has an error and no rows."""
    return files.select("path", "language", "text").mapInArrow(_extract_batches, SCHEMA)


def resolve_paths(deps: DataFrame, known: DataFrame, ctx: paths.Context) -> DataFrame:
    """``deps`` (source_file, target, kind, language, ...) with resolved_file.

    Candidates are numbered and joined with the ``known`` paths; the first that exists
    wins. A folder candidate is joined by folder and stands for its first file that is
    neither documentation nor a test. C and C++ include roots count only if one fits.
    """
    shared = deps.sparkSession.sparkContext.broadcast(ctx)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            found = [paths.candidates(*row, shared.value) for row in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(found, pa.list_(pa.string()))], names=["language", "source_file", "target", "kind", "found"])

    keys = ["language", "source_file", "target", "kind"]
    distinct = deps.select(*keys).distinct().mapInArrow(expand, ", ".join(f"{k} string" for k in keys) + ", found array<string>")
    rows = distinct.select(*keys, F.posexplode("found").alias("pos", "candidate"))
    files = known.select(F.col("path").alias("_path"))
    whole = rows.filter(~F.col("candidate").endswith("/")).join(files, F.col("candidate") == F.col("_path")).select(*keys, "pos", "_path")
    name = F.element_at(F.split("_path", "/"), -1)
    order = F.struct((name == "doc.go").alias("doc"), F.coalesce(name.rlike(r"_test\.go$"), F.lit(False)).alias("test"), F.col("_path").alias("p"))
    folders = files.filter(F.col("_path").rlike(r"\.(go|cs)$")).withColumn("_dir", F.regexp_replace("_path", "[^/]+$", ""))
    folders = folders.groupBy("_dir").agg(F.min_by("_path", order).alias("_path"))
    some = rows.filter(F.col("candidate").endswith("/")).join(folders, F.col("candidate") == F.col("_dir")).select(*keys, "pos", "_path")
    hits = whole.unionByName(some)
    first = hits.groupBy(*keys).agg(F.min_by("_path", "pos").alias("resolved_file"), F.min("pos").alias("_first"), F.count("*").alias("_n"))
    by_root = (F.col("_first") > 0) | F.col("target").startswith("<")
    c_like = F.col("language").isin("c", "cpp") & by_root & (F.col("_n") > 1)
    first = first.filter(~c_like).drop("_first", "_n")
    return deps.join(first, keys, "left")


@dataclass(frozen=True)
class Index:
    files: DataFrame
    symbols: DataFrame
    dependencies: DataFrame
    calls: DataFrame
    errors: DataFrame
    #: Digest of what paths are resolved by: metadata files and conditions.
    fingerprint: str | None = None

    def report(self) -> DataFrame:
        """One row of counts."""
        row = self.files.agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))
        for df, name in ((self.symbols, "symbols"), (self.dependencies, "dependencies"), (self.calls, "calls"), (self.errors, "errors")):
            row = row.join(F.broadcast(df.agg(F.count("*").alias(name))))
        return row


def file_id(path: str = "path"):
    """Stable over runs, unlike a counter: a hash of the path."""
    return F.xxhash64(path)


def build_index(files: DataFrame, metadata: dict[str, str] | None = None, known: DataFrame | None = None, conditions: tuple[str, ...] = paths.DEFAULT_CONDITIONS, previous: Index | None = None) -> Index:
    """Index of ``files`` (path, language, text, error, size, modified, hash, line_count).

    ``known`` are all paths that targets may resolve to, the indexed ones by default.
    With ``previous`` only files that are new or changed are parsed; the rows of others
    are taken over, those of vanished files fall away, and all calls are resolved anew.
    """
    readable = files.filter("text is not null")
    changed = readable
    if previous is not None:
        same = incremental.unchanged(readable.select("path", "size", "modified", "hash"), previous.files)
        changed = readable.join(same.select("path"), "path", "left_anti")
    parsed = materialize_bounded(extract_files(changed))
    table = materialize_bounded(readable.select(file_id().alias("id"), "path", "language", "hash", "line_count", "size", "modified"))

    symbols = parsed.select("path", "language", F.explode("symbols").alias("s")).select(file_id().alias("file_id"), "path", "language", "s.*")
    symbols = symbols.withColumn("id", F.xxhash64("path", "qualified_name", "start_line", "end_line", "kind"))
    deps = parsed.select(F.col("path").alias("source_file"), "language", F.explode("dependencies").alias("d")).select("source_file", "language", "d.*")
    calls = parsed.select("path", "language", F.posexplode("calls").alias("n", "c")).select(
        F.xxhash64("path", "n").alias("id"), file_id().alias("source_file_id"), F.col("path").alias("file"), "language", "c.caller", "c.callee",
        F.when(F.col("c.own"), F.col("path")).alias("callee_file"), "c.line", "c.column", "c.confidence",
    )
    errors = files.filter("error is not null").select("path", "error").unionByName(parsed.filter("error is not null").select("path", "error"))
    if previous is not None:
        kept = table.join(changed.select("path"), "path", "left_anti").select("path")
        symbols = symbols.unionByName(previous.symbols.join(kept, "path", "left_semi"))
        deps = deps.unionByName(previous.dependencies.select(*deps.columns).join(kept.withColumnRenamed("path", "source_file"), "source_file", "left_semi"))
        calls = calls.unionByName(previous.calls.join(kept.withColumnRenamed("path", "file"), "file", "left_semi").select(*calls.columns))
    ctx = paths.context_from(metadata or {}, conditions)
    deps = resolve_paths(deps, known if known is not None else table.select("path"), ctx).withColumn("source_file_id", file_id("source_file"))
    deps, symbols = materialize_bounded(deps), materialize_bounded(symbols)
    resolved = arms.resolve_calls(calls, deps, table, symbols)
    return Index(table, symbols, deps, materialize(resolved), materialize(errors))


def metadata_texts(spark: SparkSession, root: str) -> dict[str, str]:
    """Metadata files of a tree by relative path, installed packages included."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("path").rlike(METADATA))
    if (raw.agg(F.sum("length")).first()[0] or 0) > MAX_METADATA_CHARS:
        raise ValueError(f"metadata files of more than {MAX_METADATA_CHARS} bytes under {root}")
    rows = raw.select("path", F.col("content").cast("string").alias("text")).limit(MAX_METADATA + 1).collect()
    if len(rows) > MAX_METADATA:
        raise ValueError(f"more than {MAX_METADATA} metadata files under {root}")
    at = root.rstrip("/").split("://")[-1].lstrip("/")
    return {r["path"].split(at, 1)[1].lstrip("/"): r["text"] for r in rows}


def resolution_fingerprint(spark: SparkSession, metadata: dict[str, str], conditions: list[str]) -> str:
    """Digest of the metadata files and conditions that paths are resolved by."""
    inputs = spark.createDataFrame(list(metadata.items()), "path string, text string").select("path", F.sha2("text", 256).alias("hash"))
    return incremental.fingerprint(inputs, conditions).first()[0]


def tree_scope(root: str):
    """The scope that the configuration of a tree sets."""
    from codeloom.sources.tree import Scope, load_config

    config = load_config(root)
    return Scope(config.include, config.exclude)


def index_tree(spark: SparkSession, root: str, previous: Index | None = None) -> Index:
    """Read, scope and index the tree at ``root`` by its configuration.

    A tree whose files and resolution inputs are those of ``previous`` is not resolved again.
    """
    from codeloom.sources.tree import load_config, read_tree

    conditions = tuple(load_config(root).package_conditions)
    files = read_tree(spark, root, tree_scope(root))
    metadata = metadata_texts(spark, root)
    digest = resolution_fingerprint(spark, metadata, list(conditions))
    if previous is not None and previous.fingerprint == digest:
        now = files.filter("text is not null").select("path", "hash")
        before = previous.files.select("path", "hash")
        if now.exceptAll(before).isEmpty() and before.exceptAll(now).isEmpty():
            return previous
    return replace(build_index(files, metadata, conditions=conditions, previous=previous), fingerprint=digest)


TABLES = ("files", "symbols", "dependencies", "calls", "errors")


def select_previous(index: Index, folder: str) -> Index:
    """The same index from snapshots written under ``folder``, for the next run, which ``open_index`` finds again."""
    from codeloom.sources.records import write_manifest, write_snapshot

    spark = index.files.sparkSession
    paths_of = {n: write_snapshot(getattr(index, n), folder, n, 1) for n in TABLES}
    write_manifest(spark, folder, paths_of | {"fingerprint": index.fingerprint or ""})
    return replace(index, **{n: spark.read.parquet(p) for n, p in paths_of.items()})


def open_index(spark: SparkSession, folder: str) -> Index | None:
    """The index last written under ``folder``; None if there is none or its schema is of another version."""
    from codeloom.sources.records import read_manifest

    found = read_manifest(spark, folder)
    if found is None or any(n not in found for n in TABLES):
        return None
    return Index(*[spark.read.parquet(found[n]) for n in TABLES], fingerprint=found.get("fingerprint") or None)
