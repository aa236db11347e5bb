"""Quality by weak supervision: rules vote or abstain, EM weighs the rules.

Each document gets base counts from its whole text. Rules turn them into votes
+1 (good), -1 (bad) or 0 (abstain). Votes of all documents fall into at most
3 ** rules patterns; expectation-maximisation over the pattern counts estimates
how often each rule is right, and a document is kept by the posterior
probability that it is good. No rule can reject a document by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

SYMBOL = re.compile(r"[#*$%&|<>]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A word of letters, perhaps joined by hyphens or apostrophes, perhaps followed by punctuation.
PLAIN = re.compile(r"(?<![^\x20\x09-\x0D])[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?…]*(?![^\x20\x09-\x0D])")
SYMBOL_WORD = re.compile(r"[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*")
WINDOW = 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_plain_words", "n_symbol_words", "n_upper_words")


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice, the first included.

    Window identity is exact: ranks of words are doubled to ranks of pairs, fours and
    eights, as in prefix-doubling suffix sorting.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    step = 1
    while step < width:
        ids = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(ids, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def features(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(FEATURES)
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(SYMBOL.findall(text))
    return (
        len(words),
        sum(map(len, words)),
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(PLAIN.findall(text)),
        len(SYMBOL_WORD.findall(text)) if symbols else 0,
        sum(map(str.isupper, words)),
    )


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(1)]
        cols = list(zip(*rows)) if rows else [()] * len(FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *FEATURES])


def document_features(docs: DataFrame) -> DataFrame:
    """Counts over whole texts, one row for each input row; null text counts nothing."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_feature_batches, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in FEATURES))


def _vote(bad: Column, good: Column) -> Column:
    return F.coalesce(F.when(bad, -1).when(good, 1).otherwise(0), F.lit(0))


def default_rules() -> dict[str, Column]:
    """Rule name to vote. Every rule compares counts of one document."""
    w = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / w
    never = F.lit(False)
    return {
        "word_length": _vote((mean < 2.5) | (mean > 14), never),
        "symbols": _vote(F.col("n_symbols") / w > 0.3, F.col("n_symbols") / w < 0.1),
        "symbol_words": _vote(F.col("n_symbol_words") / w > 0.25, F.col("n_symbol_words") / w < 0.1),
        "plain_words": _vote(F.col("n_plain_words") / w < 0.6, F.col("n_plain_words") / w > 0.85),
        "repeats": _vote(F.col("n_repeat_words") / w > 0.25, never),
        "dup_lines": _vote(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) > 0.3, never),
        "upper": _vote(F.col("n_upper_words") / w > 0.5, never),
        "length": _vote(F.col("n_words") < 20, F.col("n_words") >= 60),
    }


@dataclass(frozen=True)
class VoteModel:
    rules: tuple[str, ...]
    accuracy: tuple[float, ...]
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes."""
        acc = np.asarray(self.accuracy)
        weight = np.log(acc / (1 - acc))
        logit = np.log(self.prior / (1 - self.prior)) + votes @ weight
        return 1 / (1 + np.exp(-logit))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rules: tuple[str, ...], rounds: int = 200, tol: float = 1e-9) -> VoteModel:
    """EM for one accuracy per rule and the share of good documents.

    Accuracies stay in [0.55, 0.98] and the prior in [0.05, 0.95]: rules are assumed
    better than chance, which fixes which of the two classes is the good one.
    Without documents the starting values are returned.
    """
    acc, prior = np.full(len(rules), 0.8), 0.7
    if not counts.sum():
        return VoteModel(rules, tuple(acc), prior)
    cast = patterns != 0
    for _ in range(rounds):
        good = VoteModel(rules, tuple(acc), prior).posterior(patterns)
        right = np.where(patterns > 0, good[:, None], 1 - good[:, None]) * cast
        votes = counts @ cast
        new = np.clip((counts @ right + 0.8) / (votes + 1.0), 0.55, 0.98)
        new_prior = float(np.clip((counts @ good) / counts.sum(), 0.05, 0.95))
        moved = max(abs(new - acc).max(), abs(new_prior - prior))
        acc, prior = new, new_prior
        if moved < tol:
            break
    return VoteModel(rules, tuple(float(a) for a in acc), prior)


def judge_quality(
    docs: DataFrame,
    rules: dict[str, Column] | None = None,
    least_posterior: float = 0.5,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Quality verdict on every row of ``docs`` (doc_id, text).

    Returns doc_id, the counts of FEATURES, p_good, base_failed and kept. Defined
    results: null and empty texts have no words and fail the base test; repeated rows
    each get their row; extra columns are ignored; an empty table gives no rows.
    """
    rules = rules or default_rules()
    names = tuple(rules)
    counted = materialize(document_features(docs), "features")
    voted = counted.withColumn("_pattern", F.concat_ws(",", *[rules[r].cast("string") for r in names]))
    # At most 3 ** len(rules) rows reach the driver, whatever the corpus.
    seen = voted.groupBy("_pattern").count().collect()
    texts = [r["_pattern"] for r in seen]
    patterns = np.array([[int(v) for v in t.split(",")] for t in texts], float).reshape(len(texts), len(names))
    model = fit_votes(patterns, np.array([r["count"] for r in seen], float), names)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(t, float(p)) for t, p in zip(texts, model.posterior(patterns) if len(texts) else [])], "_pattern string, p_good double"
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        voted.join(F.broadcast(table), "_pattern", "left")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= least_posterior))
        .select("doc_id", *FEATURES, "p_good", "base_failed", "kept")
    )
