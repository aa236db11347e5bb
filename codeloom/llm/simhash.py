"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two fingerprints of 8 bytes that differ in at most 3 bits differ in at most 3 bytes,
so they share at least 5 positional bytes. Of any 5 positions, 3 lie in one half of
the fingerprint; the index therefore posts every fingerprint under the 8 triples of
byte positions that lie within a half. Fingerprints that meet in a posting list are
tallied by the positional bytes they share, pairs below the guaranteed 5 are dropped,
and the rest is verified bit by bit.

Documents with equal fingerprints are one entry of the index. A posting list gives
back only links that span its groups, never all of its pairs. Lists that are too long
are posted again under one more byte, which the tally still guarantees, twice at most;
then at most 24 bits are free, and neighbours are looked up instead of compared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import bounded_join, materialize, trim
from codeloom.llm.components import connected_components

BITS = 3
#: Posting lists longer than this are posted again under one more byte.
LONG_LIST = 4096
#: Shingles whose bits are counted at a time; bounds memory, not texts.
CHUNK = 1 << 16
TRIPLES = (*itertools.combinations(range(4), 3), *itertools.combinations(range(4, 8), 3))
_digest = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    ones = np.zeros(64, np.int64)
    while len(h := np.fromiter(map(_digest, itertools.islice(shingles, CHUNK)), ">u8")):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])
    trim()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; fp is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(lambda it: _fingerprint_batches(it, width), f"doc_id {kind}, fp long")


def _byte(i: int):
    return F.shiftrightunsigned(F.col("fp"), 8 * i).bitwiseAND(F.lit(255))


def _post(fps: DataFrame) -> DataFrame:
    """Each fingerprint under the 8 triples of positional bytes: (used, key, fp); used has a bit for each position."""
    posts = []
    for t in TRIPLES:
        key = F.lit(0).cast("long")
        for i in t:
            key = key * 256 + _byte(i)
        posts.append(F.struct(F.lit(sum(1 << i for i in t)).alias("used"), key.alias("key")))
    return fps.select("fp", F.explode(F.array(*posts)).alias("_p")).select("_p.used", "_p.key", "fp")


def _post_again(lists: DataFrame) -> DataFrame:
    """Each entry under its bytes and one more: of the 4 lowest positions that are free.

    Partners share 5 positions; 3 or 4 are used, so one of any 4 free ones is shared.
    """
    free = F.slice(F.filter(F.array(*[F.lit(i) for i in range(8)]), lambda i: F.expr("used").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) == 0), 1, 4)
    one = lists.select("used", "key", "fp", F.explode(free).alias("_i"))
    byte = F.call_function("shiftrightunsigned", F.col("fp"), F.col("_i") * 8).bitwiseAND(F.lit(255))
    return one.select(F.col("used").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("_i"))).alias("used"), (F.col("key") * 256 + byte).alias("key"), "fp")


def _near(x: np.ndarray) -> np.ndarray:
    """Whether XORs belong to pairs: the tally of shared bytes first, then the bits."""
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= 8 - BITS
    shared[shared] = np.bitwise_count(x[shared]) <= BITS
    return shared


def _grow(f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the groups of one list: a found partner leaves the list."""
    out, left = [], f
    while len(left) > 1:
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            seeds = queue.pop()
            for p in seeds:
                hit = _near(left ^ p)
                if hit.any():
                    found = left[hit]
                    out.append((np.full(len(found), p), found))
                    queue.append(found)
                    left = left[~hit]
                if not len(left):
                    break
    return out


def _lookup(f: np.ndarray, used: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a long list that shares 5 bytes: flips of up to 3 of the 24 free bits."""
    out, f = [], np.sort(f)
    free = [1 << (8 * i + b) for i in range(8) if not used >> i & 1 for b in range(8)]
    for k in range(1, BITS + 1):
        for flips in itertools.combinations(free, k):
            other = f ^ np.uint64(sum(flips))
            at = np.searchsorted(f, other)
            hit = (other > f) & (f[np.minimum(at, len(f) - 1)] == other)
            if hit.any():
                out.append((f[hit], other[hit]))
    return out


def _list_links(used: np.ndarray, key: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within lists; rows of a list lie together."""
    edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (used[1:] != used[:-1])]) if len(f) else np.array([], int)
    size = np.diff(np.r_[edge, len(f)])
    links = []
    # Short lists side by side: partners at distance 1, 2, ... of the same list.
    short = np.repeat(size <= 8, size)
    of = np.repeat(np.arange(len(size)), size)
    for d in range(1, 8):
        ok = np.flatnonzero(short[:-d] & (of[:-d] == of[d:])) if len(f) > d else np.array([], int)
        near = ok[_near(f[ok] ^ f[ok + d])] if len(ok) else ok
        links.append((f[near], f[near + d]))
    for i in np.flatnonzero(size > 8):
        own = f[edge[i] : edge[i] + size[i]]
        fixed = int(used[edge[i]])
        links += _lookup(own, fixed) if len(own) > LONG_LIST and fixed.bit_count() >= 5 else _grow(own)
    return tuple(np.concatenate(x) if x else np.array([], np.uint64) for x in zip(*links)) if links else (f[:0], f[:0])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists arrive sorted; the last list of a batch may go on in the next."""
    rest = [np.array([], np.int64), np.array([], np.int64), np.array([], np.uint64)]

    def passed_on(part: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _list_links(*part)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64))], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
        rest = [np.concatenate(x) for x in zip(rest, cols)]
        if len(rest[0]):
            used, key, _ = rest
            new = np.flatnonzero((key[1:] != key[:-1]) | (used[1:] != used[:-1]))
            if len(new):
                cut = new[-1] + 1
                yield passed_on([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
    yield passed_on(rest)


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp) that differ in 1 to 3 bits.

    Not all links are given, but their components are those of all links.
    """
    lists, found = _post(fps), None
    for level in range(3):
        hot = None
        if level < 2:
            hot = materialize(lists.groupBy("used", "key").count().filter(F.col("count") > LONG_LIST).select("used", "key"), "long-lists")
            n_hot = hot.count()
        cold = bounded_join(lists, hot, ["used", "key"], "left_anti", n_hot) if hot is not None and n_hot else lists
        links = cold.repartition("used", "key").sortWithinPartitions("used", "key").mapInArrow(_link_batches, "a long, b long")
        found = links if found is None else found.union(links)
        if hot is None or not n_hot:
            return found
        lists = _post_again(bounded_join(lists, hot, ["used", "key"], "left_semi", n_hot))
    return found


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs`` (doc_id, text).

    The text is taken whole, A-Z lower-cased, split at ASCII white space. Documents
    link at 3 or fewer differing bits; component_id is the smallest doc_id that links
    reach, the document's own included. Defined results: null and empty texts have
    fingerprint zero and link like any other; repeated rows each get their row; rows of
    null doc_id belong to their component but do not name it; an empty table gives no
    rows; other columns are ignored.
    """
    marked = materialize(fingerprints(docs, width), "fingerprints")
    entries = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "entries")
    groups = connected_components(near_links(entries.select("fp")))
    # entries of no link are their own component
    named = entries.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "components")
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.select("fp", "component").join(ids, "component").select("fp", "component_id")
    fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(labels, "fp").select("doc_id", fp.alias("fingerprint"), "component_id")
