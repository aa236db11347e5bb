"""Text chunks, hash embeddings and vector search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64
#: Bytes of a digest that are used, two for each step: a place and a sign.
PAIRS = 16
BATCH = 64
TOKEN = re.compile(rb"[A-Za-z0-9_]+")
#: Characters that count as one token; the estimate is rounded up.
CHARS_PER_TOKEN = 4


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("long")


def chunk_windows(texts: DataFrame, lines: int = 80) -> DataFrame:
    """Windows of ``lines`` lines of each (file, text), as arrays cut in place: no shuffle.

    A final newline opens no line, and empty or null text has no window.
    """
    split = F.split("text", "\n", -1)
    all_lines = F.when(F.col("text").isNull() | (F.col("text") == ""), F.array().cast("array<string>")).when(
        F.col("text").endswith("\n"), F.slice(split, 1, F.size(split) - 1)
    ).otherwise(split)
    own = texts.select("file", all_lines.alias("_lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_lines") - 1, F.lit(0)), F.lit(lines))
    windows = own.select("file", "_lines", F.explode(starts).alias("_at")).filter(F.size("_lines") > 0)
    text = F.array_join(F.slice("_lines", F.col("_at") + 1, lines), "\n")
    end = F.least(F.col("_at") + lines, F.size("_lines"))
    return windows.select("file", (F.col("_at") + 1).cast("long").alias("start_line"), end.cast("long").alias("end_line"), text.alias("text")).select(
        "file", "start_line", "end_line", F.sha2("text", 256).alias("content_hash"), token_estimate(F.col("text")).alias("token_estimate"), "text"
    )


def hash_counts(text: str | None) -> np.ndarray:
    """Sums of signed token hashes in 64 places; the whole text is one token if it has none."""
    raw = (text or "").encode()
    raw = raw.lower()
    v = np.zeros(DIMENSIONS, np.float32)
    for token in TOKEN.findall(raw) or [raw]:
        digest = hashlib.sha256(token).digest()
        for i in range(0, 2 * PAIRS, 2):
            v[digest[i] % DIMENSIONS] += 1.0 if digest[i + 1] & 1 == 0 else -1.0
    return v


def _scaled(v: np.ndarray) -> tuple[np.ndarray, np.float32]:
    """``v`` at length 1 in float32, and its length before; zeros stay as they are."""
    norm = np.sqrt((v * v).sum(dtype=np.float32))
    return (v / norm if norm > 0 else v), norm


def hash_vector(text: str | None) -> np.ndarray:
    """Signed token hashes in 64 places, length 1 in float32; the whole text is one token if it has none."""
    return _scaled(hash_counts(text))[0]


def local_hash(texts: list[str | None]) -> list[np.ndarray]:
    return [hash_vector(t) for t in texts]


def local_hash_length(texts: list[str | None]) -> list[np.ndarray]:
    """Vectors of ``local_hash``, each followed by its length before it was scaled to 1."""
    return [np.append(*_scaled(hash_counts(t))) for t in texts]


#: Providers by name: a function from texts to vectors. A caller may add its own.
PROVIDERS: dict[str, tuple[str, Callable[[list[str | None]], list[np.ndarray]]]] = {
    "local-hash": ("sha256-64", local_hash),
    "local-hash-length": ("sha256-64", local_hash_length),
}


def embed(chunks: DataFrame, key: list[str], provider: str = "local-hash", batch: int = BATCH) -> DataFrame:
    """Key columns, provider, model, dimensions and vector of each row of ``chunks`` (key, text)."""
    model, function = PROVIDERS[provider]
    size = max(1, batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(key)).to_pylist()
            vectors = [v for i in range(0, len(texts), size) for v in function(texts[i : i + size])]
            if len(vectors) != len(texts):
                raise ValueError(f"{provider} gave {len(vectors)} vectors for {len(texts)} texts")
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(key))), pa.array([provider] * n), pa.array([model] * n), pa.array([len(v) for v in vectors], pa.int64()), pa.array(vectors, pa.list_(pa.float32()))],
                names=[*key, "provider", "model", "dimensions", "vector"],
            )

    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in key)
    return chunks.select(*key, "text").mapInArrow(run, f"{kinds}, provider string, model string, dimensions long, vector array<float>")


def dot(a: Column, b: Column) -> Column:
    d = lambda x: x.cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null if a length is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def vector_search(vectors: DataFrame, query: list[float], id_col: str = "id", vector: str = "vector", limit: int = 20) -> DataFrame:
    """The ``limit`` rows nearest to ``query`` by cosine; the query is a literal, nothing is shuffled but the tops."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.size(vector) == len(query)).select(id_col, F.round(cosine(F.col(vector), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(limit)


def vector_counts(chunks: DataFrame, vectors: DataFrame, provider: str, model: str, generated: int) -> DataFrame:
    """One row: chunks, vectors of the provider and model, and how many of them were reused."""
    have = vectors.filter((F.col("provider") == provider) & (F.col("model") == model)).agg(F.count("*").alias("vectors"))
    return chunks.agg(F.count("*").alias("chunks")).join(F.broadcast(have)).withColumn("reused", F.col("vectors") - generated)


@F.pandas_udf(T.BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blobs: pd.Series, dimensions: pd.Series) -> pd.Series:
    """Vectors of their bytes; null where the bytes are not ``dimensions`` floats."""
    return pd.Series([None if b is None or n is None or len(b) != 4 * n else np.frombuffer(b, "<f4") for b, n in zip(blobs, dimensions)])
