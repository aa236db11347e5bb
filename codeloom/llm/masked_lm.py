"""Masked pseudo-likelihood of documents by a bidirectional window network in numpy.

All words of the corpus are counted. The most frequent ones have an output of their own,
all others share SPARE outputs; within such an output a word's share is its count over
those of all words there, so every distinct word of the corpus has a probability of its
own, and what is known of them grows with the corpus. The counts stay in a table, by hash;
the driver gets the frequent words and one copy of the parameters.

Every task trains the network on its own documents, starting from one common
initialisation and predicting each token once from both sides, itself masked; the tasks'
parameters are averaged by tokens seen. Then every token of every document is predicted
from its neighbours, and the conditional log-probabilities are summed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, partitions, single_thread

#: Token ids: 0 stands outside the text, 1 to SPARE are hash buckets of rare words.
SPARE = 63
#: Distinct words that a task holds before it passes its counts on.
HELD_WORDS = 200_000
#: Tokens that are predicted at a time; bounds memory, not texts.
CHUNK = 32_768
#: Tokens of a training step.
STEP = 2048
#: Tokens of the corpus to a task that looks up counts of rare words.
TASK_TOKENS = 4_000_000


@dataclass(frozen=True)
class Shape:
    classes: int = 32  # the output is a class softmax, then one inside the class
    members: int = 32
    embed: int = 16
    hidden: int = 24
    reach: int = 2  # neighbours on each side
    rate: float = 0.08
    seed: int = 7

    @property
    def tokens(self) -> int:
        return self.classes * self.members

    def start(self) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        wide = 2 * self.reach * self.embed
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        return {
            "embed": (rng.standard_normal((self.tokens, self.embed)) * 0.3).astype(np.float32),
            "w1": draw(wide, self.hidden),
            "b1": np.zeros(self.hidden, np.float32),
            "w2": draw(self.hidden, self.classes) * np.float32(0.1),
            "b2": np.zeros(self.classes, np.float32),
            "w3": draw(self.classes, self.hidden, self.members) * np.float32(0.1),
            "b3": np.zeros((self.classes, self.members), np.float32),
        }


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def passed_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > HELD_WORDS:
                yield passed_on()
    yield passed_on()


hash_of = xxhash.xxh64_intdigest


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of every distinct word of all texts."""
    return docs.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> list[bytes]:
    """The ``size`` most frequent words; ties in byte order."""
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


@dataclass
class Tokens:
    """Token ids of several texts in a row, tokens of each text, and hashes and texts of the rare words among them."""

    ids: np.ndarray
    n: np.ndarray
    rare: np.ndarray
    rare_text: np.ndarray


class Tokenizer:
    """Word to token id: frequent words have their own, others share one by hash."""

    def __init__(self, vocabulary: list[bytes]):
        # Frequent words are dealt to the classes in turn, so that classes weigh about alike.
        self.ids = {w: SPARE + 1 + i for i, w in enumerate(vocabulary)}

    def encode(self, texts: list[str | None]) -> Tokens:
        split = [words_of(t) for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))
        at = np.flatnonzero(ids == 0)
        rare = np.fromiter(map(hash_of, map(words.__getitem__, at.tolist())), np.uint64, len(at))
        ids[at] = rare % np.uint64(SPARE) + np.uint64(1)
        return Tokens(ids, n, rare, np.searchsorted(np.cumsum(n), at, "right"))


@dataclass
class Stream:
    """Tokens of several texts, with room for the windows between them."""

    tokens: np.ndarray
    at: np.ndarray  # positions of real tokens
    doc: np.ndarray  # text of each of them


def lay_out(ids: np.ndarray, n: np.ndarray, reach: int) -> Stream:
    """``ids`` of texts of ``n`` tokens each."""
    begin = reach + np.cumsum(n + reach) - (n + reach)
    tokens = np.zeros(len(ids) + reach * (len(n) + 1), np.int32)
    at = np.arange(len(ids)) + np.repeat(begin - (np.cumsum(n) - n), n)
    tokens[at] = ids
    return Stream(tokens, at, np.repeat(np.arange(len(n)), n))


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums of short rows, which a product makes faster than a reduction."""
    return (x @ np.ones(x.shape[-1], x.dtype))[..., None]


#: Outputs before the softmax stay within this; their exponentials and sums fit a 32-bit float, and no row needs its maximum.
STEEPEST = 60.0


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -STEEPEST, STEEPEST)
    return x - np.log(_row_sums(np.exp(x)))


def _softmax(x: np.ndarray) -> None:
    """In place."""
    np.clip(x, -STEEPEST, STEEPEST, out=x)
    np.exp(x, out=x)
    x /= _row_sums(x)


class Network:
    def __init__(self, shape: Shape, params: dict[str, np.ndarray]):
        self.shape, self.p = shape, params
        #: Sorting keys are narrow, which numpy sorts by digits.
        self.key = np.min_scalar_type(shape.tokens)
        self.around = np.array([*range(-shape.reach, 0), *range(1, shape.reach + 1)])

    def _forward(self, tokens: np.ndarray, at: np.ndarray):
        near = tokens[at[:, None] + self.around]
        x = self.p["embed"][near].reshape(len(at), -1)
        h = x @ self.p["w1"]
        h += self.p["b1"]
        np.tanh(h, out=h)
        return near, x, h, h @ self.p["w2"] + self.p["b2"]

    def _by_class(self, target: np.ndarray):
        """Positions grouped by the class of their target: one dense product a class."""
        cls = (target % self.shape.classes).astype(self.key)
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.shape.classes + 1))
        for c in range(self.shape.classes):
            if edges[c] < edges[c + 1]:
                yield c, order[edges[c] : edges[c + 1]]

    def log_prob(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of every token of ``at`` given its neighbours."""
        out = np.empty(len(at), np.float64)
        for i in range(0, len(at), CHUNK):
            part = at[i : i + CHUNK]
            target = tokens[part]
            _, _, h, cls = self._forward(tokens, part)
            cls = _log_softmax(cls)
            own = cls[np.arange(len(part)), target % self.shape.classes].astype(np.float64)
            member = target // self.shape.classes
            for c, rows in self._by_class(target):
                inside = _log_softmax(h[rows] @ self.p["w3"][c] + self.p["b3"][c])
                own[rows] += inside[np.arange(len(rows)), member[rows]]
            out[i : i + CHUNK] = own
        return out

    def train(self, tokens: np.ndarray, at: np.ndarray, memory: dict[str, np.ndarray], batch: int = STEP) -> None:
        """AdaGrad steps on the positions ``at``; ``memory`` holds the squared gradients."""
        s, p = self.shape, self.p

        def step(name: str, grad: np.ndarray, where=...) -> None:
            m = memory[name]
            m[where] += grad * grad
            p[name][where] -= np.float32(s.rate) * grad / (np.sqrt(m[where]) + np.float32(1e-6))

        for i in range(0, len(at), batch):
            part = at[i : i + batch]
            n = np.float32(len(part))
            # Positions in the order of their target's class: a class is a slice.
            part = part[np.argsort((tokens[part] % s.classes).astype(self.key), kind="stable")]
            rows = np.arange(len(part))
            target = tokens[part]
            own, member = target % s.classes, target // s.classes
            near, x, h, d = self._forward(tokens, part)
            _softmax(d)
            d[rows, own] -= 1
            d /= n
            dh = d @ p["w2"].T
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            slices = list(zip(own[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(part)]))
            e = p["b3"][own]
            for c, lo, hi in slices:
                e[lo:hi] += h[lo:hi] @ p["w3"][c]
            _softmax(e)
            e[rows, member] -= 1
            e /= n
            w3 = np.zeros_like(p["w3"])
            for c, lo, hi in slices:
                dh[lo:hi] += e[lo:hi] @ p["w3"][c].T
                w3[c] = h[lo:hi].T @ e[lo:hi]
            step("w2", h.T @ d)
            step("b2", d.sum(0))
            step("w3", w3)  # classes without a target have no gradient and stay
            step("b3", np.add.reduceat(e, begin), own[begin])
            dz = dh * (1 - h * h)
            dx = (dz @ p["w1"].T).reshape(-1, s.embed)
            step("w1", x.T @ dz)
            step("b1", dz.sum(0))
            flat = near.ravel()
            order = np.argsort(flat.astype(self.key), kind="stable")
            flat = flat[order]
            first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            step("embed", np.add.reduceat(dx[order], first), flat[first])


def _average(table: pa.Table) -> pa.Table:
    """One row for a parameter block: the mean weighted by tokens, in a fixed order of rows."""
    rows = sorted(table.select(["task", "tokens", "values"]).to_pylist(), key=lambda r: r["task"])
    weight = np.array([r["tokens"] for r in rows], float)
    mean = np.average(np.array([np.frombuffer(r["values"], np.float32) for r in rows], float), axis=0, weights=weight).astype(np.float32)
    return pa.table({"block": [table["block"][0].as_py()], "salt": [0], "task": [rows[0]["task"]], "tokens": [int(weight.sum())], "values": [mean.tobytes()]}, schema=_BLOCKS)


_BLOCKS = pa.schema([("block", pa.string()), ("salt", pa.int32()), ("task", pa.int64()), ("tokens", pa.int64()), ("values", pa.binary())])
_BLOCKS_DDL = "block string, salt int, task long, tokens long, values binary"


@dataclass(frozen=True)
class MaskedLM:
    shape: Shape
    vocabulary: list[bytes]
    params: dict[str, np.ndarray]
    trained: int  # tokens that were predicted in training
    share: np.ndarray  # of each token id among them
    words: DataFrame  # (route, hash, n) of every rare word of the corpus
    routes: int

    def spare_counts(self) -> np.ndarray:
        """Tokens of the corpus under each shared output, 1 at least."""
        return np.maximum(self.share[: SPARE + 1].astype(float) * self.trained, 1.0)


def train_masked_lm(docs: DataFrame, shape: Shape = Shape(), salts: int = 64) -> MaskedLM:
    """Train on all texts of ``docs``; each token is predicted once.

    The driver gets the frequent words and one averaged copy of the parameters, both of
    fixed size; the counts of all other words are written as a table. Task copies are
    averaged in two levels, ``salts`` to a parameter first. Without any token the initial
    parameters are returned.
    """
    spark = docs.sparkSession
    counts = materialize(count_words(docs), "words")
    vocabulary = most_frequent(counts, shape.tokens - SPARE - 1)
    words = spark.sparkContext.broadcast(vocabulary)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        tokenizer, net = Tokenizer(words.value), Network(shape, shape.start())
        memory = {k: np.full_like(v, 1e-4) for k, v in net.p.items()}
        times = np.zeros(shape.tokens)
        seen, task = 0, None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo in range(0, len(texts), 500):
                part = texts[lo : lo + 500]
                mark = xxhash.xxh64_intdigest("\0".join((t or "")[:64] for t in part).encode("utf-8", "surrogatepass")) >> 1
                task = mark if task is None else task
                found = tokenizer.encode(part)
                stream = lay_out(found.ids, found.n, shape.reach)
                rng = np.random.default_rng([shape.seed, mark])
                at = rng.permutation(stream.at)
                net.train(stream.tokens, at, memory)
                times += np.bincount(stream.tokens[at], minlength=shape.tokens)
                seen += len(at)
        if seen:
            blocks = net.p | {"share": (times / seen).astype(np.float32)}
            n = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(blocks)), pa.array([task % salts] * n, pa.int32()), pa.array([task] * n, pa.int64()), pa.array([seen] * n, pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in blocks.values()], pa.binary())],
                schema=_BLOCKS,
            )

    copies = docs.select("text").mapInArrow(train, _BLOCKS_DDL)
    once = copies.groupBy("block", "salt").applyInArrow(_average, _BLOCKS_DDL)
    rows = once.groupBy("block").applyInArrow(_average, _BLOCKS_DDL).collect()
    params, share, trained = shape.start(), np.zeros(shape.tokens, np.float32), 0
    for r in rows:
        trained, values = r["tokens"], np.frombuffer(r["values"], np.float32)
        if r["block"] == "share":
            share = values.copy()
        else:
            params[r["block"]] = values.reshape(params[r["block"]].shape).copy()
    routes = max(partitions(spark), -(-trained // TASK_TOKENS))
    return MaskedLM(shape, vocabulary, params, trained, share, _rare_words(counts, vocabulary, routes), routes)


def _route_of(hashes: np.ndarray, routes: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(routes) >> np.uint64(24)).astype(np.int64)


def _rare_words(counts: DataFrame, vocabulary: list[bytes], routes: int) -> DataFrame:
    """(route, hash, n) of the words of ``counts`` that are not frequent."""
    known = counts.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(hash_of(w), n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in known.value]
            h = np.array([k for k, _ in kept], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_route_of(h, routes)), pa.array(h.view(np.int64)), pa.array([n for _, n in kept], pa.int64())], names=["route", "hash", "n"])

    return counts.select("word", "n").mapInArrow(hashed, "route long, hash long, n long")


#: Bits of a row's number below its partition, as monotonically_increasing_id makes it.
ROW_BITS = 33


def _deal_rare(batches: Iterator[pa.RecordBatch], routes: int) -> Iterator[pa.RecordBatch]:
    """(route, packed hashes, packed rows) of (row, packed hashes)."""
    for batch in batches:
        blobs = batch.column(1).to_pylist()
        h = np.frombuffer(b"".join(blobs), "<u8")
        row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(b) // 8 for b in blobs])
        route = _route_of(h, routes)
        order = np.argsort(route, kind="stable")
        h, row, route = h[order], row[order], route[order]
        edge = np.flatnonzero(np.r_[True, route[1:] != route[:-1]]) if len(route) else np.array([], np.int64)
        ends = [*edge[1:].tolist(), len(route)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(route[edge]), pa.array([h[a:z].tobytes() for a, z in zip(edge, ends)], pa.binary()), pa.array([row[a:z].astype("<i8").tobytes() for a, z in zip(edge, ends)], pa.binary())],
            names=["route", "hashes", "rows"],
        )


def _look_up(tokens: pa.Table, words: pa.Table) -> pa.Table:
    """(part, packed rows, packed logs): sums of log counts of the rare words on this route, by row and packed by partition.

    A word that was never counted counts once.
    """
    h = np.frombuffer(b"".join(tokens["hashes"].to_pylist()), "<u8")
    row = np.frombuffer(b"".join(tokens["rows"].to_pylist()), "<i8")
    known, n = words["hash"].to_numpy().view(np.uint64), words["n"].to_numpy()
    logs = np.zeros(len(h))
    if len(known) and len(h):
        order = np.argsort(known)
        known, n = known[order], np.log(n[order])
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        logs[hit] = n[at[hit]]
    rows, own = np.unique(row, return_inverse=True)
    sums = np.bincount(own, logs, len(rows))
    part = rows >> ROW_BITS
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.array([], np.int64)
    ends = [*edge[1:].tolist(), len(part)]
    return pa.table(
        {
            "part": pa.array(part[edge], pa.int64()),
            "rows": pa.array([rows[a:z].astype("<i8").tobytes() for a, z in zip(edge, ends)], pa.binary()),
            "logs": pa.array([sums[a:z].astype("<f8").tobytes() for a, z in zip(edge, ends)], pa.binary()),
        }
    )


def _add_up(scored: pa.Table, looked: pa.Table) -> pa.Table:
    """(doc_id, n_tokens, pll, pll_per_token) of the rows of a partition, with the sums of all routes."""
    row, pll = scored["row"].to_numpy(), scored["net"].to_numpy().copy()
    order = np.argsort(row)
    for rows, logs in sorted(zip(looked["rows"].to_pylist(), looked["logs"].to_pylist())):
        at = order[np.searchsorted(row, np.frombuffer(rows, "<i8"), sorter=order)]
        pll[at] += np.frombuffer(logs, "<f8")
    n = scored["n_tokens"].to_numpy()
    return pa.table({"doc_id": scored["doc_id"], "n_tokens": scored["n_tokens"], "pll": pa.array(pll), "pll_per_token": pa.array(pll / np.maximum(n, 1))})


def score_documents(docs: DataFrame, model: MaskedLM) -> DataFrame:
    """doc_id, n_tokens, pll and pll_per_token of every row of ``docs`` (doc_id, text).

    Whole texts are scored, every token from both of its sides; a rare word's probability
    is that of the output it shares times its part of the words counted there, one count
    for a word that the corpus does not have. Defined results: null and empty texts have no
    tokens and score 0; very long texts are scored in chunks of their tokens; repeated rows
    each get their row; extra columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.shape, model.vocabulary, model.params, -np.log(model.spare_counts())))
    routes = model.routes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        shape, vocabulary, params, less = shared.value
        tokenizer, net = Tokenizer(vocabulary), Network(shape, params)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            total, n, blobs = np.zeros(len(texts)), np.zeros(len(texts), np.int64), []
            for lo in range(0, len(texts), 500):
                found = tokenizer.encode(texts[lo : lo + 500])
                stream = lay_out(found.ids, found.n, shape.reach)
                logp = net.log_prob(stream.tokens, stream.at)
                logp += np.where(found.ids <= SPARE, less[np.minimum(found.ids, SPARE)], 0.0)
                k = len(found.n)
                total[lo : lo + k] = np.bincount(stream.doc, logp, k)
                n[lo : lo + k] = found.n
                raw, ends = found.rare.astype("<u8").tobytes(), np.cumsum(np.bincount(found.rare_text, minlength=k)) * 8
                blobs += [raw[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total), pa.array(blobs, pa.binary())], names=["row", "doc_id", "n_tokens", "net", "rare"])

    # Rows get their number in the table that is written, so a task that runs again changes nothing.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = materialize(numbered.mapInArrow(score, f"row long, doc_id {kind}, n_tokens long, net double, rare binary"), "scored")
    dealt = scored.select("row", "rare").mapInArrow(lambda it: _deal_rare(it, routes), "route long, hashes binary, rows binary")
    looked = dealt.groupBy("route").cogroup(model.words.groupBy("route")).applyInArrow(_look_up, "part long, rows binary, logs binary")
    whole = scored.select("row", "doc_id", "n_tokens", "net").withColumn("part", F.shiftright("row", ROW_BITS))
    return whole.groupBy("part").cogroup(looked.groupBy("part")).applyInArrow(_add_up, f"doc_id {kind}, n_tokens long, pll double, pll_per_token double")
