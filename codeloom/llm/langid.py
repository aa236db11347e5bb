"""Language identification of mixed-language text.

Letters form words; the script of a word narrows the languages it may belong to,
trigrams of its letters score each of them, and Viterbi over the words of a text,
with a penalty for switching, labels spans. The model is counted from labelled
documents only: nothing is known about any language beforehand.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import small_batches, trim

#: Trigrams are hashed into this many counters for each language.
BUCKETS = 1 << 16
#: Log-likelihood that a change of language between two words costs.
SWITCH = 12.0
#: A language is a candidate for a script that makes up this share of its letters.
SCRIPT_SHARE = 0.001
#: Code points that are scored together; bounds the memory of a worker, not the text.
CHUNK = 1_000_000
UNDETERMINED = "und"

# First and last code point of scripts, from the Unicode block charts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F), ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("han", 0x20000, 0x2FA1F),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter (0 if it is no letter) and its script."""
    lower = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return lower, script


@dataclass(frozen=True)
class Words:
    """Words of several texts: trigram buckets by letter, and where words begin."""

    buckets: np.ndarray  # of each letter
    first: np.ndarray  # index into buckets of each word's first letter
    doc: np.ndarray  # of each word
    start: np.ndarray  # code point offsets of each word in its text
    end: np.ndarray
    script: np.ndarray  # of each word
    scripts: np.ndarray  # of each letter


def split_words(texts: list[str]) -> Words:
    lower, script = _tables()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - (sizes + 1) + 1
    raw = np.frombuffer(("\0" + "\0".join(texts) + "\0\0").encode("utf-32-le", "surrogatepass"), "<u4")
    low = lower[raw]
    at = np.flatnonzero(low)
    a, b, c = low[at - 1], low[at], low[at + 1]
    with np.errstate(over="ignore"):
        h = (a * np.uint32(0x9E3779B1) + b) * np.uint32(0x85EBCA77) + c
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(13)
    first = np.flatnonzero(a == 0)
    last = np.flatnonzero(c == 0)
    doc = np.searchsorted(starts, at[first], "right") - 1
    scripts = script[raw[at]]
    return Words(h & np.uint32(BUCKETS - 1), first, doc, at[first] - starts[doc], at[last] + 1 - starts[doc], scripts[first], scripts)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    scores: np.ndarray  # (BUCKETS, languages) log probability of a trigram
    allowed: np.ndarray  # (scripts, languages)

    def word_scores(self, words: Words) -> np.ndarray:
        if not len(words.first):
            return np.zeros((0, len(self.languages)), np.float32)
        s = np.add.reduceat(self.scores[words.buckets], words.first, axis=0)
        ok = self.allowed[words.script]
        s[~ok & ok.any(1)[:, None]] = -1e6
        s[~ok.any(1)] = 0  # a script that no language was seen in tells nothing
        return s


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> np.ndarray:
    """Best label of every word: texts advance together, word by word, longest first."""
    n = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    begin, n = begin[order], n[order]
    k = scores.shape[1]
    value = np.zeros((n_docs, k), np.float32)
    kind = np.min_scalar_type(max(k - 1, 0))  # one byte a label suffices for 256 languages only
    came = np.zeros((len(doc), k), kind)
    own = np.arange(k, dtype=kind)
    alive = np.searchsorted(-n, -np.arange(n[0] if n_docs else 0), "left")  # texts with more than t words
    for t in range(len(alive)):
        m = alive[t]
        at, v = begin[:m] + t, value[:m]
        best = v.argmax(1).astype(kind)
        reach = v[np.arange(m), best] - np.float32(penalty)
        stay = v >= reach[:, None]
        came[at] = np.where(stay, own, best[:, None])
        v = np.where(stay, v, reach[:, None]) + scores[at]
        value[:m] = v - v.max(1, keepdims=True)
    label = np.zeros(len(doc), kind)
    state = value.argmax(1).astype(kind)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = begin[:m] + t
        label[at] = state[:m]
        state[:m] = came[at, state[:m]]
    return label


def _chunks(texts: list[str | None]) -> Iterator[list[int]]:
    """Indices of texts, long ones first, so that texts of a chunk are about equally long."""
    part: list[int] = []
    room = CHUNK
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i] or "")):
        part.append(i)
        room -= len(texts[i] or "") + 1
        if room <= 0:
            yield part
            part, room = [], CHUNK
    if part:
        yield part


def label_texts(texts: list[str | None], model: LanguageModel, penalty: float = SWITCH, spans: bool = False) -> list[tuple]:
    """(language, share of letters labelled so, spans) of each text, from the whole text."""
    out: list[tuple] = [(UNDETERMINED, 0.0, [])] * len(texts)
    k = len(model.languages)
    if not k:
        return out
    for part in _chunks(texts):
        words = split_words([texts[i] or "" for i in part])
        label = viterbi(model.word_scores(words), words.doc, len(part), penalty)
        letters = np.zeros((len(part), k), np.int64)
        # Letters of a script that no language was seen in count for none of them.
        size = words.end - words.start
        known = np.where(model.allowed.any(1)[words.script], size, 0)
        np.add.at(letters, (words.doc, label), known)
        total, best = np.bincount(words.doc, size, len(part)), letters.argmax(1)
        where: list[list] = [[] for _ in part]
        if spans and len(label):
            new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (words.doc[1:] != words.doc[:-1])])
            until = np.r_[new[1:], len(label)] - 1
            for a, z in zip(new, until):
                where[words.doc[a]].append({"start": int(words.start[a]), "end": int(words.end[z]), "lang": model.languages[label[a]]})
        for j, i in enumerate(part):
            if total[j]:
                out[i] = (model.languages[best[j]], float(letters[j, best[j]] / total[j]), where[j])
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts of each language over a partition; scripts count below zero."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            own = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
            for part in _chunks(texts):
                words = split_words([texts[i] for i in part])
                own[:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(words.scripts, minlength=len(SCRIPT_NAMES))
    trim()
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])], names=["lang", "slot", "n"])


def train_languages(labelled: DataFrame) -> LanguageModel:
    """Count all of ``labelled`` (lang, text). The driver gets at most BUCKETS sums a language."""
    spark = labelled.sparkSession
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sums = known.mapInArrow(_count_batches, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    with small_batches(spark):
        counts = sums.toArrow()
    lang = np.array(counts["lang"].to_pylist(), dtype=object)
    languages = tuple(sorted(set(lang)))
    n = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    if languages:
        n[counts["slot"].to_numpy(), np.searchsorted(np.array(languages, dtype=object), lang)] = counts["n"].to_numpy()
    tri, script = n[:BUCKETS], n[BUCKETS:]
    scores = np.log((tri + 0.1) / (tri.sum(0) + 0.1 * BUCKETS)).astype(np.float32)
    return LanguageModel(languages, scores, script >= SCRIPT_SHARE * np.maximum(script.sum(0), 1))


def detect_languages(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans (start, end, lang; code points) of every row of ``docs``.

    Only text is looked at. Defined results: null, empty and letterless texts are
    ``und`` with score 0 and no span, and so is everything if no language was learned;
    letters of a script that no language was seen in lower the score, down to 0; very
    long texts are labelled whole, their words held at once; extra columns are ignored;
    equal scores go to the language first in code point order; repeated rows each get
    their row; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = label_texts(batch.column(1).to_pylist(), shared.value, penalty, spans)
            cols = [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
            if spans:
                cols.append(pa.array([r[2] for r in rows], span))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "spans"][: len(cols)])
        trim()

    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return docs.select("doc_id", "text").mapInArrow(label, schema)


def held_out(doc_id: str = "doc_id"):
    """True where the document must not be learned from; null ids are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
