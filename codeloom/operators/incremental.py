"""Snapshots against what is stored: upserts, deletions, chunk diffs, missing vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_KEY = ["file", "start_line", "end_line"]


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and the stored rows whose key it does not have."""
    return new.unionByName(stored.join(new.select(*key), key, "left_anti"))


def stale(stored: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows whose key was not seen."""
    return stored.join(seen.select(*key), key, "left_anti")


def replace_children(stored: DataFrame, new: DataFrame, parent: str, changed: DataFrame) -> DataFrame:
    """Children of changed parents give way to ``new``; the others stay."""
    return stored.join(changed.select(parent), parent, "left_anti").unionByName(new)


def unchanged(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """Seen files (path, size, modified, hash) that need no parse.

    Equal size and time are enough; otherwise an equal hash is.
    """
    s = stored.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("hash").alias("_hash"))
    joined = seen.join(s, "path")
    same_stat = (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
    return joined.filter(F.coalesce(same_stat, F.lit(False)) | (F.col("hash") == F.col("_hash"))).select(*seen.columns)


def chunk_diff(stored: DataFrame, desired: DataFrame) -> DataFrame:
    """(file, start_line, end_line, change, old_hash, new_hash): added, updated and removed chunks."""
    old = stored.select(*CHUNK_KEY, F.col("content_hash").alias("old_hash"), F.lit(True).alias("_old"))
    new = desired.select(*CHUNK_KEY, F.col("content_hash").alias("new_hash"), F.lit(True).alias("_new"))
    both = old.join(new, CHUNK_KEY, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "updated")
    )
    return both.withColumn("change", change).filter("change is not null").select(*CHUNK_KEY, "change", "old_hash", "new_hash")


def diff_counts(diff: DataFrame, desired: DataFrame) -> DataFrame:
    one = diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "removed")])
    return desired.agg(F.count("*").alias("total")).join(F.broadcast(one))


def kept_vectors(vectors: DataFrame, diff: DataFrame) -> DataFrame:
    """Vectors of chunks that were neither updated nor removed."""
    return vectors.join(diff.filter("change <> 'added'").select(*CHUNK_KEY), CHUNK_KEY, "left_anti")


def missing_vectors(chunks: DataFrame, vectors: DataFrame, provider: str, model: str, key: list[str]) -> DataFrame:
    have = vectors.filter((F.col("provider") == provider) & (F.col("model") == model)).select(*key)
    return chunks.join(have, key, "left_anti")


#: Leading hex digits of a path's digest that name its bucket: 4,096 buckets.
_BUCKET_DIGITS = 3


def fingerprint(inputs: DataFrame, conditions: list[str]) -> DataFrame:
    """One row: SHA-256 over the conditions in order and over (path, hash or 'missing') of all files.

    Files fall into 4,096 buckets by the digest of their path; each is hashed in path
    order in its own task, and what meets in one row is one digest a bucket, whatever the
    number of files.
    """
    row = F.sha2(F.concat(F.col("path"), F.lit("\0"), F.coalesce("hash", F.lit("missing"))), 256)
    rows = inputs.select("path", row.alias("d"), F.substring(F.sha2("path", 256), 1, _BUCKET_DIGITS).alias("bucket"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda r: r["d"]), "\0")
    buckets = rows.groupBy("bucket").agg(F.sha2(joined(F.struct("path", "d")), 256).alias("d"))
    whole = buckets.agg(joined(F.struct("bucket", "d")).alias("_rows"))
    return whole.select(F.sha2(F.concat(F.lit("\0".join(conditions) + "\0"), "_rows"), 256).alias("fingerprint"))
