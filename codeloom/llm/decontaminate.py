"""Benchmark decontamination by winnowing, in built-in functions only.

Of every ``w`` consecutive k-gram hashes of a text the smallest is its fingerprint;
with k + w - 1 words to a benchmark window, every document that contains a window has
the window's fingerprint. Fingerprints of documents and benchmark are joined; the
documents that share one are looked at again, word by word, and hits are extended to
every window that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BROADCAST_ROWS, ascii_lower, bounded_join, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a benchmark window; shorter items are one window.
WINDOW = 10
#: Words of a hashed k-gram, so that WINDOW - GRAM + 1 of them lie in a window.
GRAM = 5


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shift(a: Column, places: int) -> Column:
    return F.slice(a, places + 1, F.greatest(F.size(a), F.lit(1)))


def gram_columns(df: DataFrame, words: str, n: int, out: str) -> DataFrame:
    """Add ``out``: the hash of the ``n`` words from each place, by doubling.

    The last ``n - 1`` places hash the fewer words that are left; such values only widen
    a candidate search, and saving them spares three array copies a level.

    Intermediate arrays are columns of their own, so that each is computed once. Explode
    the result with the outer form only: for the inner one the planner infers a filter on
    the array's size and pushes it through all of these columns, copying each of them
    several times at every level.
    """
    df = df.withColumn("_h1", F.transform(words, lambda w: F.xxhash64(w)))
    have, step = {1: "_h1"}, 1
    while step * 2 <= n:
        name = f"_h{step * 2}"
        df = df.withColumn(name, F.zip_with(have[step], _shift(F.col(have[step]), step), lambda a, b: F.xxhash64(a, b)))
        step *= 2
        have[step] = name
    done, at = have[step], step
    while at < n:
        part = max(s for s in have if s <= n - at)
        name = f"_g{at + part}"
        df = df.withColumn(name, F.zip_with(done, _shift(F.col(have[part]), at), lambda a, b: F.xxhash64(a, b)))
        done, at = name, at + part
    return df.withColumn(out, F.col(done)).drop(*[c for c in df.columns if c.startswith(("_h", "_g"))])


def winnow_columns(df: DataFrame, grams: str, width: int, out: str) -> DataFrame:
    """Add ``out``: the smallest of the ``width`` hashes from each place, fewer at the end."""
    at, done, made = 1, grams, []
    while at < width:
        step = min(at, width - at)
        name = f"_m{at + step}"
        df = df.withColumn(name, F.zip_with(done, _shift(F.col(done), step), lambda a, b: F.least(a, b)))
        done, at = name, at + step
        made.append(name)
    return df.withColumn(out, F.col(done)).drop(*made)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (len, text, item) of every window of (item_id, text); rows of null item_id are one item of null id."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("_words")).filter(F.size("_words") > 0)
    n = F.least(F.size("_words"), F.lit(window)).alias("len")
    starts = items.select("item_id", "_words", n).withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_words") - F.col("len") + 1)))
    text = F.array_join(F.slice("_words", F.col("_at"), F.col("len")), " ")
    return starts.select("len", text.alias("text"), F.col("item_id").alias("item")).distinct()


def _fingerprints(df: DataFrame, length: int, window: int, gram: int, out: str) -> DataFrame:
    """Add ``out``, the fingerprints of ``_words`` for windows of ``length`` words.

    The first one of a window of exactly ``length`` words stands for the window.
    """
    if length < window:
        return gram_columns(df, "_words", length, out)
    return winnow_columns(gram_columns(df, "_words", gram, "_grams"), "_grams", window - gram + 1, out).drop("_grams")


def _prints(windows: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """Distinct fingerprints of ``windows`` (len, text) of all ``lengths``."""
    out = None
    for length in lengths:
        own = windows.filter(F.col("len") == length).select(F.split("text", " ").alias("_words"))
        own = _fingerprints(own, length, window, gram, "_fp").select(F.posexplode_outer("_fp").alias("_place", "_print")).filter("_place = 0").select("_print")
        out = own if out is None else out.unionAll(own)
    return out.distinct()


def _keys(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(_n, _window, _print): every window of ``windows`` with the hash of all its words."""
    out = None
    for length in lengths:
        own = gram_columns(windows.filter(F.col("len") == length).select("len", "text", F.split("text", " ").alias("_words")), "_words", length, "_key")
        own = own.select(F.col("len").alias("_n"), F.col("text").alias("_window"), F.posexplode_outer("_key").alias("_place", "_print")).filter("_place = 0").drop("_place")
        out = own if out is None else out.unionAll(own)
    return out


def _placed(keys: str, n: int) -> Column:
    """The hashes of ``keys`` with their places and the number of words that they stand for."""
    return F.transform(keys, lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("at"), h.alias("fp")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """How much of each document of ``docs`` (doc_id, text) is benchmark text.

    A window is ``window`` consecutive words of an item of ``benchmark`` (item_id, text),
    or a shorter item as a whole. Returns doc_id, n_words, n_hit (words inside an
    occurrence of a window), n_items, items_sha256 (of the comma-joined item ids in
    string order), contaminated and items.

    Documents are read twice, whatever the lengths of windows: once for fingerprints,
    once to look at those that share one.

    Defined results: null texts have no words; items without words have no window; items
    of null id are one item, whose windows count like any other and which n_items counts,
    though it has no id to list; a doc_id names a document, so rows that repeat it are one
    row, their words counted in the longest of them and hit places united; null doc_id is
    one document too; very long texts are looked at whole; extra columns are ignored;
    empty tables give no rows or no hits.
    """
    pairs = materialize(benchmark_windows(benchmark, window), "windows")
    windows = materialize(pairs.select("len", "text").distinct(), "distinct-windows")
    # At most ``window`` numbers reach the driver.
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())
    n_windows, n_pairs = windows.count(), pairs.count()
    worded = docs.select("doc_id", words_of(F.col("text")).alias("_words"))
    counted = worded.select("doc_id", "_words", F.size("_words").cast("long").alias("n_words"))

    if not lengths:
        return counted.groupBy("doc_id").agg(F.max("n_words").alias("n_words")).select(
            "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"),
            F.lit(False).alias("contaminated"), F.array().cast("array<string>").alias("items"),
        )
    marked = counted
    for length in lengths:
        marked = _fingerprints(marked, length, window, gram, f"_fp{length}")
    every = [F.col(f"_fp{length}") for length in lengths]
    marked = marked.withColumn("_fp", F.array_distinct(F.concat(*every) if len(every) > 1 else every[0]))
    marked = marked.select("doc_id", "n_words", F.explode_outer("_fp").alias("_fp"))
    joined = bounded_join(marked, _prints(windows, lengths, window, gram), F.col("_fp") == F.col("_print"), "left", n_windows)
    seen = joined.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.max(F.col("_print").isNotNull()).alias("suspect"))
    seen = materialize(seen, "suspects")

    suspects = seen.filter("suspect").select(F.col("doc_id").alias("_doc"))
    own = bounded_join(docs.select("doc_id", "text"), suspects, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi", suspects.count())
    own = own.select("doc_id", words_of(F.col("text")).alias("_words"))
    for length in lengths:
        own = gram_columns(own, "_words", length, f"_key{length}")
    places = [_placed(f"_key{n}", n) for n in lengths]
    placed = own.select("doc_id", "_words", F.explode_outer(F.concat(*places) if len(places) > 1 else places[0]).alias("_p"))
    placed = placed.select("doc_id", "_words", F.col("_p.n").alias("_len"), F.col("_p.at").alias("_at"), F.col("_p.fp").alias("_fp"))
    here = F.array_join(F.slice("_words", F.col("_at") + 1, F.col("_len")), " ")
    same = (F.col("_fp") == F.col("_print")) & (F.col("_len") == F.col("_n"))
    keys = _keys(windows, lengths)
    if n_windows <= BROADCAST_ROWS:
        found = placed.join(F.broadcast(keys), same).filter(here == F.col("_window"))
    else:  # the words stay behind; the windows themselves are compared
        found = placed.select("doc_id", "_len", "_at", "_fp", here.alias("_here")).join(keys, same & (F.col("_here") == F.col("_window")))
    hits = materialize(found.select("doc_id", F.col("_at").alias("start"), (F.col("_at") + F.col("_len")).alias("end"), "_window"), "hits")
    # Places of one document: united by a sweep over their sorted starts.
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    sweep = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "end"))),
        zero,
        lambda acc, s: F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("n")),
    )["n"]
    hit_words = hits.groupBy(F.col("doc_id").alias("_d1")).agg(sweep.alias("n_hit"))
    named = bounded_join(hits.select("doc_id", "_window").distinct(), pairs.select(F.col("text").alias("_window"), "item"), ["_window"], "inner", n_pairs)
    id_text = F.col("item").cast("string")
    items = named.groupBy(F.col("doc_id").alias("_d2")).agg(F.sort_array(F.collect_set(id_text)).alias("items"), F.max(id_text.isNull().cast("long")).alias("_nameless"))
    out = seen.join(hit_words, F.col("doc_id").eqNullSafe(F.col("_d1")), "left").join(items, F.col("doc_id").eqNullSafe(F.col("_d2")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        (F.size(found).cast("long") + F.coalesce("_nameless", F.lit(0).cast("long"))).alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        found.alias("items"),
    )
