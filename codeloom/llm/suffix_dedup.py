"""Exact removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if it lies in a string of SPAN bytes that also starts earlier (smaller
doc_id, or earlier in the same document). Sorting every suffix of a corpus would move
each text a hundred times, so suffixes are first thinned out without losing a match:
of any SPAN bytes, the smallest hash of the K-grams inside marks an anchor, the same
one wherever the string occurs. Only anchors whose K-gram occurs twice are sorted.

1. Anchors of all texts are dealt by hash; those that occur once are dropped.
2. Texts are dealt by document group together with the hashes that are left, and give
   the bytes around each such anchor: SPAN - K to the left, SPAN to the right. Within
   a document group equal surroundings are sent once, so that a passage that very many
   documents share is sent once for each group.
3. Surroundings are dealt by hash again and sorted as suffixes: multikey quicksort to
   a shallow depth, blind tries for the groups that agree beyond it. The sorted order
   with its common prefixes tells which strings occur earlier.
4. Texts are dealt by document group once more and cut.

Anchors and surroundings travel packed in binary rows. The number of document groups,
of buckets and of tasks follows the bytes of all texts, so that none of them grows with
the corpus. A hash that very many document groups hold is sorted in two steps: its
surroundings are dealt by FAN groups first, where equal ones become one, and only what is
left of each deal meets in one bucket.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, partitions, running_total, trim

SPAN = 100
K = 40
LEFT = SPAN - K
#: Texts of a batch that are held as bytes at a time.
ROWS = 2000
#: Bytes hashed at a time; longer texts are hashed in pieces that overlap by SPAN - 1.
PIECE = 1 << 20
#: Suffixes are quicksorted to this depth.
SHALLOW = 16
#: Segments of the quicksort below this size are sorted at once.
SMALL = 4096
#: Groups of suffixes up to this size are compared pair by pair, inside the sorted order.
FEW = 6
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
NULL_ID = -(1 << 63)
#: Bytes of text of a document group and of a task; both are held by a worker as a whole or in part.
GROUP_BYTES, TASK_BYTES = 16 << 20, 64 << 20
#: A hash that more document groups than this hold is dealt by so many groups at a time first.
FAN = 64
#: Routes from here on are such deals.
HOT = 1 << 40
#: Positions of the n-th row of a doc_id are offset by n times this.
REPEAT = 1 << 40


# --- anchors -----------------------------------------------------------------------


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a random value a byte."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    n = PIECE + 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)], dtype=np.uint64)
    return up, down, np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the K-gram at each position of ``b``."""
    up, down, values = _powers()
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(values[b] * up[: len(b)], out=total[1:])
    h = (total[K:] - total[:-K]) * down[: len(b) - K + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[:-step], v[step:])
        have += step
    return v


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the anchors of ``texts``, in order.

    Every string of SPAN bytes has one, which its bytes alone determine.
    """
    pieces: list[tuple[int, int, int]] = []
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - SPAN + 1), PIECE - SPAN + 1):
            pieces.append((i, at, min(len(t), at + PIECE)))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    start = 0
    while start < len(pieces):
        stop, size = start, 0
        while stop < len(pieces) and (size + pieces[stop][2] - pieces[stop][1] <= PIECE or stop == start):
            size += pieces[stop][2] - pieces[stop][1]
            stop += 1
        part = pieces[start:stop]
        start = stop
        lengths = np.array([z - a for _, a, z in part])
        ends = np.cumsum(lengths)
        b = np.frombuffer(b"".join(memoryview(texts[i])[a:z] for i, a, z in part), np.uint8)
        h = _hashes(b)
        # The low bits give way to the position: the leftmost of nearly equal hashes wins.
        low = np.uint64((1 << 21) - 1)
        v = _sliding_min(h & ~low | np.arange(len(h), dtype=np.uint64), LEFT + 1)
        ok = np.ones(len(v), bool)  # windows that lie within a piece
        for e in ends[:-1]:
            ok[max(0, e - SPAN + 1) : e] = False
        v = v[ok]
        at = (v[np.r_[True, v[1:] != v[:-1]]] & low).astype(np.int64)
        own = np.searchsorted(ends, at, "right")
        of = np.array([i for i, _, _ in part])
        shift = np.array([a for _, a, _ in part]) - (ends - lengths)
        out.append((of[own], at + shift[own], h[at]))
    if not out:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.uint64)
    doc, pos, h = (np.concatenate(x) for x in zip(*out))
    # Overlapping pieces of one text may name an anchor twice.
    new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
    return doc[new], pos[new], h[new]


def _shift(buckets: int) -> np.uint64:
    """Bits of a code below its bucket."""
    return np.uint64(48 if buckets <= 1 << 16 else 40)


def _codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper 16 or 24 bits of a mixed hash, the lower bits of which lie below.

    Hashes of anchors are minima and therefore small; mixed one to one, they spread evenly.
    """
    shift = _shift(buckets)
    low = (np.uint64(1) << shift) - np.uint64(1)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return ((h >> shift) * np.uint64(buckets) >> (np.uint64(64) - shift)) << shift | h & low


# --- step 1 and 2: hashes that occur twice ------------------------------------------


def _group_type(groups: int) -> str:
    return "<u2" if groups <= 1 << 16 else "<u4"


def _deal_anchors(batches: Iterator[pa.RecordBatch], buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    """(bucket, packed entries); an entry is a hash and a document group, twice if it occurs again there."""
    shift, kind = _shift(buckets), _group_type(groups)
    for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        group = part.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        doc, _, h = anchors([t or b"" for t in part.column(1).to_pylist()])
        code = _codes(h, buckets)
        order = np.lexsort((group[doc], code))
        code, g = code[order], group[doc][order]
        if len(code) > 2:  # at most two of a kind
            again = (code[2:] == code[:-2]) & (g[2:] == g[:-2])
            code, g = code[np.r_[True, True, ~again]], g[np.r_[True, True, ~again]]
        own = (code >> shift).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.array([], np.int64)
        blobs = []
        for a, z in zip(edge, [*edge[1:], len(code)]):
            c, gg = code[a:z] & ((np.uint64(1) << shift) - np.uint64(1)), g[a:z]
            blobs.append((c & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (c >> np.uint64(32)).astype("<u2").tobytes() + gg.astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(own[edge], pa.int64()), pa.array(blobs, pa.binary())], names=["route", "blob"])
    trim()


def _bucket_repeats(route: int, blobs: list[bytes], buckets: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, group, hot) of the hashes of a bucket that occur at least twice anywhere, by group."""
    kind = np.dtype(_group_type(groups))
    size = 6 + kind.itemsize
    codes, owners = [], []
    for blob in blobs:
        n = len(blob) // size
        low, high = np.frombuffer(blob, "<u4", n), np.frombuffer(blob, "<u2", n, 4 * n)
        codes.append(np.uint64(route) << _shift(buckets) | high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64))
        owners.append(np.frombuffer(blob, kind, n, 6 * n).astype(np.int64))
    code, group = np.concatenate(codes), np.concatenate(owners)
    order = np.lexsort((group, code))
    code, group = code[order], group[order]
    same = code[1:] == code[:-1]
    twice = np.r_[same, False] | np.r_[False, same]
    code, group = code[twice], group[twice]
    if not len(code):
        return code, group, np.array([], bool)
    new = np.r_[True, (code[1:] != code[:-1]) | (group[1:] != group[:-1])]
    code, group = code[new], group[new]
    edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    holders = np.diff(np.r_[edge, len(code)])
    hot = np.repeat(holders > FAN, holders)
    order = np.lexsort((code, group))
    return code[order], group[order], hot[order]


def _by_route(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Routes of sorted rows with all their blobs, one route at a time."""
    now, held = None, []
    for batch in batches:
        for route, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if route != now and held:
                yield now, held
                held = []
            now = route
            held.append(blob)
    if held:
        yield now, held


def _find_repeats(batches: Iterator[pa.RecordBatch], buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    """(group, packed codes, packed hot codes): for each document group its hashes that occur at least twice anywhere."""
    for route, blobs in _by_route(batches):
        code, group, hot = _bucket_repeats(route, blobs, buckets, groups)
        if len(code):
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.r_[edge[1:], len(code)]
            pack = lambda a, z, which: code[a:z][which[a:z]].astype("<u8").tobytes()
            cold = ~hot
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[edge], pa.int64()), pa.array([pack(a, z, cold) for a, z in zip(edge, ends)], pa.binary()), pa.array([pack(a, z, hot) for a, z in zip(edge, ends)], pa.binary())],
                names=["route", "blob", "hot"],
            )
    trim()


# --- step 3: surroundings of the anchors that are left -------------------------------


def _rows_in_order(table: pa.Table) -> tuple[pa.Table, list[int], list[bytes], list[int]]:
    """Rows by doc_id and text; positions of a row that repeats a doc_id are shifted by REPEAT."""
    ids = [NULL_ID if i is None else i for i in table["_id"].to_pylist()]
    texts = [t or b"" for t in table["_bytes"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    shift = [0] * len(ids)
    for i in range(1, len(ids)):
        if ids[i] == ids[i - 1]:
            shift[i] = shift[i - 1] + REPEAT
    return table.take(pa.array(order, pa.int64())), ids, texts, shift


def _pack_cuts(ids: list[int], starts: list[int], ends: list[int]) -> bytes:
    return zstandard.compress(np.array([ids, starts, ends], "<i8").tobytes(), 1)


def _unpack_cuts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), "<i8").reshape(3, -1)


HEADER = np.dtype([("doc", "<i8"), ("pos", "<i8"), ("group", "<u4"), ("left", "u1"), ("right", "u1")])


def _pack_around(rows: list[Around]) -> bytes:
    """(doc, pos, group, left, right, bytes) of surroundings in one blob."""
    head = np.array([r[:5] for r in rows], HEADER)
    return zstandard.compress(struct.pack("<q", len(rows)) + head.tobytes() + b"".join(r[5] for r in rows), 1)


def _surroundings(docs: pa.Table, repeats: pa.Table, buckets: int) -> pa.Table:
    """(route, blob): surroundings of repeated anchors by bucket, those of hot hashes by deal; cuts found here by document group."""
    routes: list[int] = []
    blobs: list[bytes] = []
    found, hot_found = repeats["blob"].to_pylist(), repeats["hot"].to_pylist()
    if docs.num_rows and found:
        hot = np.sort(np.concatenate([np.frombuffer(b, "<u8") for b in hot_found]))
        wanted = np.sort(np.concatenate([hot, *[np.frombuffer(b, "<u8") for b in found]]))
        group = docs["_group"][0].as_py()
        _, ids, texts, shift = _rows_in_order(docs)
        doc, pos, h = anchors(texts)
        code = _codes(h, buckets)
        hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code)
        first: set[tuple[int, bytes]] = set()
        sent: dict[int, list[Around]] = {}
        cuts: tuple[list[int], list[int], list[int]] = ([], [], [])
        bucket = (code[hit] >> _shift(buckets)).astype(np.int64)
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, code[hit]), len(hot) - 1)] == code[hit]
            bucket = np.where(is_hot, HOT + (group // FAN << 24) + bucket, bucket)
        for d, p, k in zip(doc[hit].tolist(), pos[hit].tolist(), bucket.tolist()):
            t = texts[d]
            left, right = min(p, LEFT), min(SPAN, len(t) - p)
            around = t[p - left : p + right]
            key = (left, around)
            if key in first:  # an earlier row of this group has the same bytes here
                cuts[0].append(ids[d])
                cuts[1].append(shift[d] + p - left)
                cuts[2].append(shift[d] + p + right)
            else:
                first.add(key)
                sent.setdefault(k, []).append((ids[d], shift[d] + p, group, left, right, around))
        for k, rows in sent.items():
            routes.append(k)
            blobs.append(_pack_around(rows))
        if cuts[0]:
            routes.append(buckets + group)
            blobs.append(_pack_cuts(*cuts))
    out = pa.table({"route": pa.array(routes, pa.int64()), "blob": pa.array(blobs, pa.binary())})
    del routes, blobs, found
    trim()
    return out


# --- step 4: deep-shallow sorting ----------------------------------------------------


def shallow_sort(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of ``keys`` (columns of 8 bytes each) by multikey quicksort.

    Three-way partitions on one column at a time; equal parts go on to the next.
    """
    order = np.arange(len(keys))
    stack = [(0, len(keys), 0)]
    while stack:
        lo, hi, col = stack.pop()
        if col == keys.shape[1] or hi - lo < 2:
            continue
        own = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = own[np.lexsort(keys[own, col:].T[::-1])]
            continue
        k = keys[own, col]
        pivot = np.sort(k[[0, len(k) // 2, -1]])[1]
        less, more = k < pivot, k > pivot
        same = ~(less | more)
        order[lo:hi] = np.concatenate([own[less], own[same], own[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        stack += [(lo, a, col), (a, b, col + 1), (b, hi, col)]
    return order


def common_prefix(x: bytes, y: bytes) -> int:
    if x == y:
        return len(x)
    n = min(len(x), len(y))
    a, b = x[:n], y[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


class BlindTrie:
    """Branch depths and branch bytes only; strings are looked at once on insertion."""

    __slots__ = ("root", "strings")

    def __init__(self) -> None:
        self.root: list | None = None  # leaf: [None, string, members]; branch: [depth, children]
        self.strings = 0

    def add(self, x: bytes, member: int) -> None:
        if self.root is None:
            self.root = [None, x, [member]]
            return
        node = self.root
        while node[0] is not None:
            kids = node[1]
            child = kids.get(x[node[0]] if node[0] < len(x) else -1)
            node = child if child is not None else next(iter(kids.values()))
        y = node[1]
        if x == y:
            node[2].append(member)
            return
        depth = common_prefix(x, y)
        at = lambda s: s[depth] if depth < len(s) else -1
        parent, branch, node = None, None, self.root
        while node[0] is not None and node[0] < depth:
            parent, branch = node, x[node[0]]
            node = node[1][branch]
        leaf = [None, x, [member]]
        if node[0] == depth:
            node[1][at(x)] = leaf
            return
        fork = [depth, {at(y): node, at(x): leaf}]
        if parent is None:
            self.root = fork
        else:
            parent[1][branch] = fork

    def ordered(self) -> tuple[list[int], list[int]]:
        """Members in order of their strings, and the common prefix of each with the one before."""
        members, prefix = [], []
        stack = [(self.root, 0)] if self.root else []
        while stack:
            node, depth = stack.pop()
            if node[0] is None:
                members += node[2]
                prefix += [depth] + [len(node[1])] * (len(node[2]) - 1)
            else:
                kids = [node[1][b] for b in sorted(node[1])]
                stack += [(k, node[0]) for k in reversed(kids[1:])]
                stack.append((kids[0], depth))
        return members, prefix


def _reach(order: list[int], prefix: list[int], head: list[tuple], lefts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(member, bytes to the left, bytes to the right) of the earlier strings around an anchor.

    All strings contain the anchor's K-gram, so those that occur earlier overlap: the
    widest on each side bound what is to be cut. ``head`` gives (doc, pos, left, right).
    """
    n = len(order)
    if n <= FEW:
        for j in range(n):
            m = order[j]
            most_left = most_right = -1
            for i in range(n):
                e = order[i]
                if i == j or head[e][:2] > head[m][:2]:
                    continue
                right = min(prefix[min(i, j) + 1 : max(i, j) + 1])
                left = common_prefix(lefts[m], lefts[e])
                if left + right >= SPAN:
                    most_left, most_right = max(most_left, left), max(most_right, right)
            if most_right >= 0:
                yield m, most_left, most_right
        return
    # A large group: for each depth, members fall into classes of equal right parts, and
    # with the left part that completes SPAN bytes into classes of equal strings.
    rank = np.empty(n, np.int64)
    lcp = np.array(prefix)
    by_place = sorted(range(n), key=lambda j: head[order[j]][:2])
    most_left, most_right = [-1] * n, [-1] * n
    for left in range(LEFT + 1):
        right = SPAN - left
        rank[:] = np.cumsum(lcp < right)
        seen: set[tuple[int, bytes]] = set()
        for j in by_place:
            m = order[j]
            if head[m][2] < left or head[m][3] < right:
                continue
            key = (rank[j].item(), lefts[m][:left])
            if key in seen:
                most_left[j] = left
                if most_right[j] < 0:
                    most_right[j] = right
            else:
                seen.add(key)
    for j in range(n):
        if most_left[j] >= 0:
            yield order[j], most_left[j], most_right[j]


class _Cuts:
    """Cuts of document groups, packed for each."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[list[int], list[int], list[int]]] = {}

    def add(self, group: int, doc: int, start: int, end: int) -> None:
        c = self.of.setdefault(group, ([], [], []))
        c[0].append(doc)
        c[1].append(start)
        c[2].append(end)

    def rows(self, buckets: int) -> tuple[list[int], list[bytes]]:
        return [buckets + g for g in self.of], [_pack_cuts(*c) for c in self.of.values()]


#: Surroundings of an anchor: doc, pos, document group, bytes to the left and to the right, and the bytes.
Around = tuple[int, int, int, int, int, bytes]


def _unpack_around(blob: bytes) -> Iterator[Around]:
    raw = zstandard.decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    at = 8 + n * HEADER.itemsize
    for doc, pos, group, left, right in np.frombuffer(raw, HEADER, n, 8).tolist():
        yield doc, pos, group, left, right, raw[at : at + left + right]
        at += left + right


def _distinct(blobs: list[bytes], cuts: _Cuts) -> list[Around]:
    """Of equal surroundings the earliest is left; the others are cut whole, as all their strings occur there.

    Blobs are taken one by one and dropped, so that copies take no memory.
    """
    first: dict[tuple[int, bytes], Around] = {}
    while blobs:
        for row in _unpack_around(blobs.pop()):
            key = row[3], row[5]
            known = first.setdefault(key, row)
            if known is not row:
                if row[:2] < known[:2]:
                    first[key], row = row, known
                cuts.add(row[2], row[0], row[1] - row[3], row[1] + row[4])
    return list(first.values())


def earlier_strings(rows: list[Around]) -> Iterator[tuple[int, int, int, int]]:
    """(document group, doc, start, end) of every cut that distinct surroundings of a bucket give."""
    if len(rows) < 2:
        return
    keys = np.frombuffer(b"".join(r[5][r[3] : r[3] + SHALLOW] for r in rows), np.uint8).reshape(-1, SHALLOW).view(">u8").astype(np.uint64)
    order = shallow_sort(keys)
    sorted_keys = keys[order]
    edge = np.flatnonzero(np.r_[True, (sorted_keys[1:] != sorted_keys[:-1]).any(1)])
    ends = np.r_[edge[1:], len(order)]
    for a, z in zip(edge[ends - edge > 1].tolist(), ends[ends - edge > 1].tolist()):
        own = [rows[i] for i in order[a:z].tolist()]
        head = [(doc, pos, left, right) for doc, pos, _, left, right, _ in own]
        trie, lefts = BlindTrie(), []
        for j, (_, _, _, left, _, around) in enumerate(own):
            trie.add(around[left:], j)
            lefts.append(around[:left][::-1])
        members, prefix = trie.ordered()
        # Only strings that share the anchor's K-gram can share SPAN bytes around it.
        cut = [i for i, p in enumerate(prefix) if p < K] + [len(members)]
        for lo, hi in zip(cut, cut[1:]):
            if hi - lo > 1:
                for m, left, right in _reach(members[lo:hi], [0, *prefix[lo + 1 : hi]], head, lefts):
                    doc, pos, group = own[m][:3]
                    yield group, doc, pos - left, pos + right


def _sort_buckets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(route, blob): cuts by document group. Routes come in order; one bucket is held at a time.

    A deal of a hot hash is not sorted yet: what is left of it goes on under its bucket's
    own number. Cuts that were found before are passed through.
    """
    batch_of = lambda routes, blobs: pa.RecordBatch.from_arrays([pa.array(routes, pa.int64()), pa.array(blobs, pa.binary())], names=["route", "blob"])
    for route, blobs in _by_route(batches):
        if buckets <= route < HOT:
            yield batch_of([route] * len(blobs), blobs)
            continue
        cuts = _Cuts()
        rows = _distinct(blobs, cuts)
        if route >= HOT:
            yield batch_of([(route - HOT) & 0xFFFFFF], [_pack_around(rows)])
        else:
            for found in earlier_strings(rows):
                cuts.add(*found)
        yield batch_of(*cuts.rows(buckets))
    trim()


# --- step 5: cutting -----------------------------------------------------------------


def merge_runs(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of [start, end)."""
    out: list[list[int]] = []
    for a, z in sorted(zip(start.tolist(), end.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _cut(docs: pa.Table, cuts: pa.Table, names: list[str], texts: bool) -> pa.Table:
    docs, ids, raw, shift = _rows_in_order(docs)
    of: dict[tuple[int, int], tuple[list, list]] = {}
    for blob in cuts["blob"].to_pylist():
        doc, start, end = _unpack_cuts(blob)
        for d, a, z in zip(doc.tolist(), start.tolist(), end.tolist()):
            rep = a // REPEAT * REPEAT
            c = of.setdefault((d, rep), ([], []))
            c[0].append(a - rep)
            c[1].append(z - rep)
    spans, kept = [], []
    for i, t, s in zip(ids, raw, shift):
        c = of.get((i, s))
        runs = merge_runs(np.array(c[0]), np.array(c[1])) if c else []
        spans.append(runs)
        at, parts = 0, []
        for a, z in runs:
            parts.append(t[at:a])
            at = z
        parts.append(t[at:])
        kept.append(parts)
    out = {n: docs[n] for n in names}
    if texts:
        # Characters that a cut went through are dropped; a null text stays null.
        null = docs["_bytes"].is_null().to_pylist()
        out["_text"] = pa.array([None if no else "".join(p.decode("utf-8", "ignore") for p in parts) for no, parts in zip(null, kept)], pa.string())
    return pa.table(
        out
        | {
            "n_bytes": pa.array(map(len, raw), pa.int64()),
            "n_removed": pa.array([sum(z - a for a, z in r) for r in spans], pa.int64()),
            "n_spans": pa.array(map(len, spans), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(b"".join(p)).hexdigest() for p in kept], pa.string()),
            "spans": pa.array([[{"start": a, "end": z} for a, z in r] for r in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }
    )


def _release(spark: SparkSession) -> None:
    """Ask the driver to let go of shuffle files of the jobs that are over."""
    spark.sparkContext._jvm.System.gc()


def _numbered(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` and the place of a row's doc_id among all: integers stand for themselves, other ids are ranked."""
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return docs, F.col("doc_id").cast("long")
    ids = docs.select(F.col("doc_id").alias("_ranked")).filter("_ranked is not null").distinct().withColumn("_one", F.lit(1).cast("long")).withColumn("_all", F.lit(0))
    ranks = materialize(running_total(ids, "_all", ["_ranked"], "_one", "_rank").select("_ranked", "_rank"), "ranks")
    return docs.join(ranks, docs["doc_id"] == ranks["_ranked"], "left").drop("_ranked"), F.col("_rank")


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Cut repeated strings of SPAN bytes from the texts of ``docs`` (doc_id, text).

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left) and
    spans (start, end; bytes of the UTF-8 text); with ``texts`` also every column of
    ``docs``, text being what is left with characters that were cut through dropped, and
    a result whose name is taken ends in ``_cut``.
    Strings are judged on the input, not on what is left of it.

    Defined results: null and empty texts have no bytes; texts shorter than SPAN lose
    nothing; very long texts are cut whole, hashed in pieces; doc_ids of any type that
    can be ordered will do; a null doc_id comes before all others; rows that repeat a
    doc_id follow each other in order of their texts, so of rows that agree the first is
    kept whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    taken = docs.columns
    docs, number = _numbered(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number reaches the driver
    groups = min(1 << 24, max(4 * partitions(spark), -(-size // GROUP_BYTES)))
    buckets = tasks = min(1 << 24, max(partitions(spark), -(-size // TASK_BYTES)))
    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("long").alias("_group")
    raw = F.col("text").cast("binary").alias("_bytes")
    number = number.alias("_id")
    thin = docs.select(group, raw)
    row = "route long, blob binary"
    dealt = lambda df: df.repartition(tasks, "route").sortWithinPartitions("route")

    repeats = dealt(thin.mapInArrow(lambda it: _deal_anchors(it, buckets, groups), row)).mapInArrow(lambda it: _find_repeats(it, buckets, groups), row + ", hot binary")
    repeats = materialize(repeats, "repeats")
    _release(spark)

    own = docs.select(group, number, raw).repartition(tasks, "_group")
    around = own.groupBy("_group").cogroup(repeats.repartition(tasks, "route").groupBy("route")).applyInArrow(lambda d, r: _surroundings(d, r, buckets), row)
    cuts = materialize(dealt(around).mapInArrow(lambda it: _sort_buckets(it, buckets), row), "cuts")
    _release(spark)
    left = cuts.filter(F.col("route") < buckets)
    cuts = cuts.filter(F.col("route") >= buckets)
    if not left.isEmpty():
        cuts = cuts.unionByName(materialize(dealt(left).mapInArrow(lambda it: _sort_buckets(it, buckets), row), "hot-cuts"))
    cuts = cuts.select((F.col("route") - buckets).alias("route"), "blob")

    # Columns of the input go through under numbers, so that no name clashes.
    carried = [c for c in taken if c != "text"] if texts else ["doc_id"]
    numbered = {f"_c{i}": c for i, c in enumerate(carried)}
    full = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in numbered.items()], group, number, raw).repartition(tasks, "_group")
    fields = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in numbered.items()] + ["_text string"] * texts
    schema = ", ".join(fields) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    cut = full.groupBy("_group").cogroup(cuts.repartition(tasks, "route").groupBy("route")).applyInArrow(lambda d, c: _cut(d, c, list(numbered), texts), schema)
    back = {c: n for n, c in numbered.items()} | ({"text": "_text"} if texts else {})
    kept = [F.col(back[c]).alias(c) for c in taken if c in back]
    results = [F.col(c).alias(c if c not in carried else c + "_cut") for c in RESULTS]
    return cut.select(*kept, *results)
