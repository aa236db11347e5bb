"""Decontamination, SimHash and suffix dedup against brute force; chat pairs; edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import simhash, suffix_dedup
from codeloom.llm.chat_pairs import format_preferences, stale_answer_pairs
from codeloom.llm.components import connected_components
from codeloom.llm.decontaminate import decontaminate
from codeloom.llm.simhash import near_duplicates
from codeloom.llm.suffix_dedup import remove_repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, _words string, n string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def frame(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in rows], DOCS)


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "delta", "épée", "naïve", "x1", "zeta-eta", "ß", "omega", "日本"]
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4:
            words = (rng.choice(texts) or "").split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
        elif kind < 0.45:
            texts.append(rng.choice(["", None, " \n\t", "ab", "..."]))
        elif kind < 0.5:
            texts.append("ab" * rng.randrange(1, 300))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 90))))
    return list(enumerate(texts))


# --- decontamination -------------------------------------------------------------


def contaminated(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(low(text))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        sha = hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, limit):
    import codeloom.llm.common
    import codeloom.llm.decontaminate

    monkeypatch.setattr(codeloom.llm.common, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(codeloom.llm.decontaminate, "BROADCAST_ROWS", limit)
    docs = corpus(5) + [(500, " ".join(f"w{i % 5003}" for i in range(60_000)))]
    texts = [t for _, t in docs if t and len(WORD.findall(t)) > 25]
    items = [(7, " ".join(texts[0].split(" ")[3:17])), (10, texts[1]), (9, "Alpha beta gamma"), (8, ""), (6, None), (None, texts[2]), (5, texts[1].upper()), (7, "omega")]
    found = decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == contaminated(docs, items)
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_decontamination_of_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = [(1, "one two three"), (1, "one two three"), (2, None)]
    got = decontaminate(frame(spark, docs), none).select("doc_id", "n_words", "n_hit", "contaminated").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 0, False), (2, 0, 0, False)]
    item = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    got = decontaminate(frame(spark, docs), item).select("doc_id", "n_words", "n_hit", "contaminated").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 2, True), (2, 0, 0, False)]
    assert decontaminate(frame(spark, []), item).count() == 0
    null_id = decontaminate(frame(spark, [(None, "two three")]), item).collect()
    assert [(r["doc_id"], r["n_hit"]) for r in null_id] == [(None, 2)]


def test_items_of_null_id_contaminate(spark):
    items = spark.createDataFrame([(None, "two three"), (None, "five"), (4, "five six")], "item_id long, text string")
    rows = decontaminate(frame(spark, [(1, "one two three"), (2, "five six"), (3, "seven")]), items).collect()
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in rows}
    assert got == {1: (2, 1, [], True), 2: (2, 2, ["4"], True), 3: (0, 0, [], False)}


def test_a_window_of_very_many_items_is_not_broadcast(spark, monkeypatch):
    import codeloom.llm.common

    monkeypatch.setattr(codeloom.llm.common, "BROADCAST_ROWS", 50)
    items = spark.createDataFrame([(i, "the same words") for i in range(200)], "item_id long, text string")
    rows = decontaminate(frame(spark, [(1, "here the same words are"), (2, "none")]), items).collect()
    assert {r["doc_id"]: r["n_items"] for r in rows} == {1: 200, 2: 0}


def test_decontamination_runs_no_python(spark, sf_dir):
    from codeloom.llm.queries import op1_decontaminate

    plan = op1_decontaminate(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- SimHash ---------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    bits = [sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    docs = corpus(8)
    fps = [plain_fingerprint(t) for _, t in docs]
    component = plain_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(frame(spark, docs)).collect()}
    assert got == {i: (f"{fps[i]:016x}", component[i]) for i, _ in docs}


def test_simhash_of_very_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(4000)}" for _ in range(90_000))
    got = {r["doc_id"]: r["fingerprint"] for r in near_duplicates(frame(spark, [(1, long), (2, long + " end")])).collect()}
    assert got == {1: f"{plain_fingerprint(long):016x}", 2: f"{plain_fingerprint(long + ' end'):016x}"}
    whole = simhash.fingerprint(long.encode())
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(long.encode()) == whole == plain_fingerprint(long)


def test_simhash_edge_cases(spark):
    docs = [(5, None), (3, ""), (3, ""), (None, " \n"), (9, "a b")]
    rows = near_duplicates(frame(spark, docs)).collect()
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(rows) == 5 and len(zero) == 4 and {r["component_id"] for r in zero} == {3}
    assert near_duplicates(frame(spark, [])).count() == 0


def test_long_lists_lose_no_link(spark, monkeypatch):
    """Lists are posted again, and looked up in the end, with the same components."""
    monkeypatch.setattr(simhash, "LONG_LIST", 6)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(150):
        f = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(100)})
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"))
    groups = {r["node"]: r["component"] for r in connected_components(links).collect()}
    got = {}
    for (s,), f in zip(signed, fps):
        got.setdefault(groups.get(s, s), set()).add(f)
    want = {}
    for f, c in zip(fps, plain_components(fps)):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_lookup_finds_what_comparison_finds():
    rng = random.Random(2)
    f = np.array(sorted({rng.getrandbits(24) & 0x0F0F07 for _ in range(300)}), np.uint64)
    pairs = lambda links: {tuple(sorted((int(a), int(b)))) for x, y in links for a, b in zip(x, y)}
    want = {(int(a), int(b)) for i, a in enumerate(f) for b in f[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 3}
    assert pairs(simhash._lookup(f, 0b11111000)) == want


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)}


# --- suffix dedup ----------------------------------------------------------------


def plain_cuts(docs, span=100):
    seen, out = set(), []
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            if w in seen:
                gone[i : i + span] = b"\1" * span
            seen.add(w)
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cuts_equal_brute_force(spark, seed):
    docs = corpus(seed)
    got = sorted(map(tuple, remove_repeats(frame(spark, docs)).select(*COLUMNS).collect()))
    assert got == plain_cuts(docs)
    assert sum(r[2] for r in got) > 0


def test_cuts_with_shared_passages_of_many_kinds(spark):
    """Passages cut at different places, so that groups of surroundings are large and varied."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(260))
    docs = []
    for i in range(60):
        a, z = rng.randrange(0, 130), rng.randrange(131, 261)
        pad = lambda: "".join(rng.choice("klmnop ") for _ in range(rng.randrange(0, 80)))
        docs.append((i, pad() + passage[a:z] + pad()))
    got = sorted(map(tuple, remove_repeats(frame(spark, docs)).select(*COLUMNS).collect()))
    assert got == plain_cuts(docs)


def test_cut_edge_cases(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh") for _ in range(150))
    docs = [(2, text), (2, text), (1, text[:99]), (4, None), (3, ""), (None, text + "é")]
    got = remove_repeats(frame(spark, docs), texts=True)
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "fp", "_words", "n", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"}
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_removed"], r["text"]) for r in got.collect()), key=str)
    assert rows == sorted([(-1, 0, text + "é"), (1, 0, text[:99]), (2, 150, ""), (2, 150, ""), (3, 0, ""), (4, 0, None)], key=str)
    assert remove_repeats(frame(spark, [])).count() == 0
    taken = frame(spark, [(1, text), (2, text)]).selectExpr("text", "doc_id", "n AS n_removed", "fp AS spans", "fp AS _c0", "fp AS _group", "fp AS _id", "fp AS _text")
    rows = {r["doc_id"]: (r["n_removed"], r["n_removed_cut"], r["text"], r["_c0"], r["_text"]) for r in remove_repeats(taken, texts=True).collect()}
    assert rows == {1: ("y", 0, text, 1, 1), 2: ("y", 150, "", 1, 1)}


def test_cuts_of_text_ids(spark):
    docs = [(f"d{i:04d}", t) for i, t in corpus(2)]
    got = sorted(map(tuple, remove_repeats(spark.createDataFrame(docs, "doc_id string, text string")).select(*COLUMNS).collect()))
    assert got == plain_cuts(docs)


@pytest.mark.parametrize("fan", [1, 2])
def test_hot_hashes_are_dealt_twice(spark, monkeypatch, fan):
    """A passage that most groups hold, whole and at its ends, goes through deals and comes out the same."""
    monkeypatch.setattr(suffix_dedup, "FAN", fan)
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(400))
    docs = []
    for i in range(150):
        pad = lambda: "".join(rng.choice("klmnop ") for _ in range(rng.randrange(0, 150)))
        docs.append((i, pad() + passage[rng.randrange(0, 40) : 400 - rng.randrange(0, 40)] + pad()))
    got = sorted(map(tuple, remove_repeats(frame(spark, docs)).select(*COLUMNS).collect()))
    assert got == plain_cuts(docs)


def test_wide_codes_hold_bucket_and_hash():
    h = np.random.default_rng(3).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for buckets in (7, 1 << 16, 200_000):
        code = suffix_dedup._codes(h, buckets)
        assert int((code >> suffix_dedup._shift(buckets)).max()) < buckets and len(set(code.tolist())) == 1000


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(9)
    text = bytes(rng.randrange(256) for _ in range(3000)) * 2
    whole = suffix_dedup.anchors([text])
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    cut = suffix_dedup.anchors([text])
    assert [x.tolist() for x in whole] == [x.tolist() for x in cut]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40))
def test_blind_trie_orders_and_measures(strings):
    trie = suffix_dedup.BlindTrie()
    for i, s in enumerate(strings):
        trie.add(s, i)
    members, prefix = trie.ordered()
    ordered = [strings[m] for m in members]
    assert ordered == sorted(strings)
    assert prefix[1:] == [suffix_dedup.common_prefix(a, b) for a, b in zip(ordered, ordered[1:])]


def test_shallow_sort_orders(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SMALL", 4)
    keys = np.random.default_rng(1).integers(0, 5, (500, 2), dtype=np.uint64)
    order = suffix_dedup.shallow_sort(keys)
    assert keys[order].tolist() == sorted(keys.tolist())


# --- chat pairs ------------------------------------------------------------------


def test_preference_pairs(spark):
    turn = lambda r, t: {"role": r, "text": t}
    shared = [turn("system", "s"), turn("user", "q")]
    pairs = [
        (1, [*shared, turn("assistant", "yes"), turn("user", "ok"), turn("assistant", "bye")], [*shared, turn("assistant", "no")]),
        (2, shared, shared),
        (3, None, [turn(None, None)]),
        (4, [], []),
    ]
    kind = "array<struct<role:string,text:string>>"
    rows = {r["pair_id"]: r for r in format_preferences(spark.createDataFrame(pairs, f"pair_id long, chosen {kind}, rejected {kind}")).collect()}
    one = rows[1]
    assert one["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n" and one["prompt_turns"] == 2
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_spans"]] == ["yes<|end|>\n", "bye<|end|>\n"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_spans"]] == ["no<|end|>\n"]
    assert (rows[2]["prompt_turns"], rows[2]["chosen"], rows[2]["chosen_spans"]) == (2, "", [])
    assert (rows[3]["prompt"], rows[3]["chosen"], rows[3]["rejected"]) == ("", "", "<|unknown|>\n<|end|>\n")
    assert rows[4]["prompt_turns"] == 0


def test_stale_answers(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 3, "assistant", "b"), (2, 0, "user", "x"), (3, 0, "assistant", None), (None, 0, "user", "n"), (4, None, None, "z")]
    pairs = {r["pair_id"]: r for r in stale_answer_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    texts = lambda turns: [t["text"] for t in turns]
    assert (texts(pairs[1]["chosen"]), texts(pairs[1]["rejected"])) == (["q", "a", "r", "b"], ["q", "a", "r", "a"])
    assert (texts(pairs[2]["chosen"]), texts(pairs[2]["rejected"])) == (["x"], ["x"])
    assert (texts(pairs[3]["chosen"]), texts(pairs[3]["rejected"])) == ([""], [])
    assert None in pairs and 4 in pairs
    assert stale_answer_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_preferences_with_clashing_columns_and_long_turns(spark):
    long = "word " * 60_000
    rows = [(1, 0, "user", long, "p", 7), (1, 1, "assistant", "a", "p", 7), (1, 1, "assistant", "a", "p", 7), (1, 2, "assistant", "b", "p", 7)]
    pairs = stale_answer_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string, pair_id long"))
    got = format_preferences(pairs.withColumn("prompt", F.lit("taken")).withColumn("turns", F.lit(1))).collect()
    assert [(r["pair_id"], r["prompt"], r["chosen"], r["rejected"]) for r in got] == [(1, f"<|user|>\n{long}<|end|>\n<|assistant|>\na<|end|>\n", "<|assistant|>\nb<|end|>\n", "<|assistant|>\na<|end|>\n")] or got[0]["prompt"].startswith("<|user|>\n" + long)
    assert len(got) == 1
