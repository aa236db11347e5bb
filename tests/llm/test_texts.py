"""Language ID, HTML, language model, mixing, quality and URL operators; the pipeline."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import langid, masked_lm, quality_votes
from codeloom.llm.html_tree import choose_text, extract_main_text, parse_blocks
from codeloom.llm.langid import detect_languages, held_out, train_languages, viterbi
from codeloom.llm.mixing import mix_sources, source_targets
from codeloom.llm.quality_votes import features, fit_votes, judge_quality, repeated_words
from codeloom.llm.queries import QUERIES
from codeloom.llm.url_reputation import Rule, filter_urls
from tests import oracle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, _slice long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 1, "k", 2) for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- language ID -----------------------------------------------------------------


def test_held_out_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op3_language_id"](spark, sf_dir).collect() if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows)
    assert len(rows) > 30 and right >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_spans_of_mixed_text(spark, docs):
    model = train_languages(docs)
    en = next(r["text"] for r in docs.filter("lang = 'en' and n_chars between 300 and 900").collect() if "***" not in r["text"])[:300]
    de = next(r["text"] for r in docs.filter("lang = 'de' and n_chars between 300 and 900").collect() if "***" not in r["text"])[:300]
    (lang, share, spans), *rest = langid.label_texts([en + " " + de, None, "", "12 !?", "Ж"], model, spans=True)
    assert [s["lang"] for s in spans] == ["en", "de"] and 0.3 < share < 0.8
    assert abs(spans[1]["start"] - len(en)) < 40
    assert [r[:2] for r in rest[:3]] == [("und", 0.0)] * 3
    assert rest[3][0] in model.languages


def test_viterbi_equals_plain_dynamic_programming():
    rng = np.random.default_rng(4)
    n = [0, 7, 1, 30, 12]
    doc = np.repeat(np.arange(5), n)
    scores = rng.normal(size=(len(doc), 3)).astype(np.float32) * 3
    got = viterbi(scores, doc, 5, 2.0)
    at = 0
    for length in n:
        s = scores[at : at + length].astype(float)
        value = lambda path: sum(s[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        best = np.zeros(3)
        for row in s:
            best = np.maximum(best, best.max() - 2.0) + row
        if length:
            assert value(got[at : at + length].tolist()) == pytest.approx(best.max(), abs=1e-3)
        at += length


def test_labels_of_more_than_256_languages():
    scores = np.zeros((5, 300), np.float32)
    scores[:, 299] = 1
    assert viterbi(scores, np.zeros(5, int), 1, 2.0).tolist() == [299] * 5


def test_unseen_scripts_lower_the_score(spark):
    model = train_languages(frame(spark, [(1, "some plain words of a language", "en", "s")]))
    rows = langid.label_texts(["words of it", "Жизнь", "words Жизнь"], model)
    assert [round(r[1], 2) for r in rows] == [1.0, 0.0, 0.5] and {r[0] for r in rows} == {"en"}


def test_nothing_learned_nothing_told(spark):
    model = train_languages(frame(spark, [(1, "abc", None, "s"), (2, None, "en", "s")]))
    rows = detect_languages(frame(spark, [(1, "abc", "en", "s"), (1, "abc", "en", "s"), (None, None, None, None)]), model).collect()
    assert [(r["lang_pred"], r["score"], r["spans"]) for r in rows] == [("und", 0.0, [])] * 3
    assert detect_languages(frame(spark, []), model).count() == 0


def test_chunks_do_not_matter(spark, docs, monkeypatch):
    model = train_languages(docs)
    texts = [r["text"] for r in docs.limit(40).collect()]
    whole = langid.label_texts(texts, model, spans=True)
    monkeypatch.setattr(langid, "CHUNK", 500)
    assert langid.label_texts(texts, model, spans=True) == whole


def test_a_very_long_text_is_labelled_whole(spark, docs):
    model = train_languages(docs)
    parts = {lang: " ".join(r["text"] for r in docs.filter(f"lang = '{lang}' and n_chars between 300 and 900").limit(20).collect() if "***" not in r["text"]) for lang in ("en", "de")}
    text = (parts["en"] + " ") * 60 + (parts["de"] + " ") * 90
    (lang, share, spans), = langid.label_texts([text], model, spans=True)
    letters = lambda t: sum(c.isalpha() for c in t)
    assert len(text) > 500_000 and lang == ("de" if letters(parts["de"]) * 90 > letters(parts["en"]) * 60 else "en") and 0.4 < share < 0.9 and len(spans) >= 2


def test_held_out_follows_crc32(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id"), held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


# --- HTML ------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<article><h1>Title &amp; more</h1><p>First  <b>bold</b>
line.<br>After break<p>Second &eacute;&#233;&#x41;</p><script>x()</script><div class="ad">Buy</div><ul><li>one<li>two</ul>
<table><tr><td>c1</td><td>c2</td></tr></table><form><p>Name <input></p><button>Go</button></form><section id="comments"><p>Nice!</p></section></article>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_article_text():
    assert choose_text(parse_blocks(PAGE), {}, 0.2) == "Title & more\n\nFirst bold line. After break\n\nSecond ééA\n\none\n\ntwo\n\nc1\n\nc2"


def test_page_without_article():
    page = "<body><div class=menu><a href=x>Home</a></div><div><p>Real text of the page.</p><p>More</p></div><div class='footer'>foot</div></body>"
    assert choose_text(parse_blocks(page), {}, 0.2) == "Real text of the page.\n\nMore"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "plain", "<script>never closed", "</p></div>", "<b><i>x</b></i>", "<p>" * 3000 + "deep", "&#xD800; &#99999999; &nope;"])
def test_broken_pages_do_not_crash(page):
    choose_text(parse_blocks(page), {}, 0.2)


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=x><p>Same words on every page of the site</p></div><div class=y><p>Own text number {i} of the page</p></div></body>") for i in range(8)]
    rows += [(100, "http://other.example/1", "<body><div class=x><p>Same words on every page of the site</p></div></body>"), (101, None, None)]
    got = {r["page_id"]: r for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["text"] for i in range(8)] == [f"Own text number {i} of the page" for i in range(8)]
    assert got[100]["text"] == "Same words on every page of the site" and got[100]["n_chars"] == 36
    assert (got[101]["text"], got[101]["n_chars"]) == ("", 0)
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_site_that_repeats_one_article_keeps_it(spark):
    page = "<body><article><h1>Title</h1><p>The same article on every page of the host.</p></article></body>"
    rows = [(i, f"http://h.example/{i}", page) for i in range(9)]
    rows += [(10 + i, f"http://g.example/{i}", f"<body><article><p>Article {i} of a host with furniture</p><p class=s>Share</p></article></body>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(9)} == {"Title\n\nThe same article on every page of the host."}
    assert got[13] == "Article 3 of a host with furniture"


def plain_importance(pages, gamma=0.9):
    """Importance of every node of well-formed pages of one host, by recursion over whole pages."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.at, self.kids, self.texts = [], defaultdict(list), defaultdict(list)

        def handle_starttag(self, tag, attrs):
            name = tag + "".join("." + c for k, v in attrs if k == "class" for c in sorted(v.split()))
            self.kids["/".join(self.at)].append((len(self.at), name))
            self.at.append(name)
            self.kids["/".join(self.at)].append(None)  # a new element of this path begins

        def handle_endtag(self, tag):
            self.at.pop()

        def handle_data(self, data):
            if data.strip():
                self.kids["/".join(self.at)].append((len(self.at), "#"))
                self.texts["/".join([*self.at, "#"])].append(data.strip())

    shown, said, mass = defaultdict(Counter), defaultdict(Counter), Counter()
    for page in pages:
        t = Tree()
        t.feed(page)
        for path, kids in t.kids.items():
            if path:
                styles, now = set(), []
                for k in kids[1:] + [None]:
                    if k is None:
                        styles.add(tuple(now))
                        now = []
                    elif not now or now[-1] != k[1]:
                        now.append(k[1])
                shown[path][frozenset(styles)] += 1
        for path, texts in t.texts.items():
            shown[path]["#"] += 1
            said[path].update(set(texts))
            for x in texts:
                mass[path] += len(x)
                for n in range(1, path.count("/") + 1):
                    mass["/".join(path.split("/")[:n])] += len(x)

    def importance(path):
        m = sum(shown[path].values())
        if path in said:
            return 1.0 if m < 2 else 1 - sum(math.log(n, m) for n in said[path].values()) / len(said[path])
        pres = 1.0 if m < 2 else -sum(n / m * math.log(n / m, m) for n in shown[path].values())
        kids = [k for k in shown if k.rpartition("/")[0] == path]
        total = sum(mass[k] for k in kids)
        below = sum(mass[k] * importance(k) for k in kids) / total if total else pres
        share = gamma ** (len(shown[path]) - 1)
        return (1 - share) * pres + share * below

    return {path: (sum(shown[path].values()), mass[path], importance(path)) for path in shown}


def _site(n, seed=5):
    """Pages of a host without declared areas: furniture that repeats, one varying line in it, an article of its own."""
    rng = random.Random(seed)
    words = lambda k: " ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(k))
    out = []
    for i in range(n):
        links = "".join(f"<li>Section number {k} of the site</li>" for k in range(6))
        box = f"<div class='box'><ul>{links}</ul><p>{rng.choice(['one', 'two', 'three'])}</p></div>" if i % 4 else ""
        body = "".join(f"<p>{words(12)} {i}</p>" + ("<ul><li>point " + words(3) + "</li></ul>" if rng.random() < 0.4 else "") for _ in range(rng.randrange(1, 5)))
        out.append((i, f"http://h.example/{i}", f"<html><body>{box}<div class='text'><h1>{words(4)}</h1>{body}</div><div class='end'><span>All rights reserved by the site</span></div></body></html>"))
    return out


def test_importance_equals_brute_force(spark):
    from codeloom.llm.html_tree import style_tree

    site = _site(30)
    got = {r["path"]: (r["n"], r["mass"], r["importance"]) for r in style_tree(spark.createDataFrame(site, "page_id long, url string, html string")).collect()}
    want = plain_importance([re.sub("</?span>", "", h) for _, _, h in site])
    assert set(got) == {"/" + p for p in want}
    for path, (n, mass, importance) in want.items():
        assert got["/" + path][:2] == (n, mass) and got["/" + path][2] == pytest.approx(importance, abs=1e-9), path
    assert got["/html/body/div.box"][2] < 0.2 < got["/html/body/div.text"][2]


def test_the_tree_decides(spark):
    """The branch goes as a whole, its varying line included; with the tree switched off it stays."""
    site = spark.createDataFrame(_site(30), "page_id long, url string, html string")
    on = {r["page_id"]: r["text"] for r in extract_main_text(site).collect()}
    off = {r["page_id"]: r["text"] for r in extract_main_text(site, least_pages=10**9).collect()}
    assert all(on[i] != off[i] for i in on)
    assert not any("Section number" in t or "rights" in t or re.search(r"(^|\n)(one|two|three)(\n|$)", t) for t in on.values())
    for i, _, h in _site(30):
        paragraphs = re.findall(r"<p>([^<]{20,})</p>", h)
        assert paragraphs and all(p in on[i] for p in paragraphs)


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="layout has-sidebar"><article><p>Kept text</p></article></div>', "Kept text"),
        ('<div class="post tags-news"><p>Kept text</p></div>', "Kept text"),
        ('<div class="sidebar"><article><p>First article</p></article></div>', "First article"),
        ('<article><p>Long article with many words in it</p></article><section class="comments"><article><p>Nice!</p></article></section>', "Long article with many words in it"),
        ("<article><p>A long first article with many words in it, far more than the other</p></article><article><p>Short</p></article>", "A long first article with many words in it, far more than the other\n\nShort"),
        ('<div><p><a href="x">A linked line of the text</a></p><p>More</p></div>', "A linked line of the text\n\nMore"),
        ('<div class="notice"><p>Only a notice here</p></div>', "Only a notice here"),
        ('<div class="site-footer"><p>Foot</p></div><div role="navigation"><p>Go</p></div><p>Body</p>', "Body"),
    ],
)
def test_names_of_areas(page, text):
    assert choose_text(parse_blocks(f"<body>{page}</body>"), {}, 0.2) == text


def test_extra_columns_and_long_and_deep_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} of a very long page</p>" for i in range(20_000)) + "</article>"
    deep = "<div>" * 500 + "deep" + "</div>" * 500
    rows = [(1, "http://a.b/1", long, "x", "y"), (2, "http://a.b/2", deep, "x", "y"), (2, "http://a.b/2", deep, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string")
    got = sorted((r["page_id"], len(r["text"])) for r in extract_main_text(pages).collect())
    assert got == [(1, len("\n\n".join(f"Paragraph {i} of a very long page" for i in range(20_000)))), (2, 4), (2, 4)]


def test_pages_give_their_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
    rows = QUERIES["op5_html_tree"](spark, sf_dir).collect()
    same = 0
    for r in rows:
        number = int(re.search(r"://[^/]*/(?:\w\w/)?(\d+)", r["url"])[1])
        same += squeeze(r["text"].partition("\n\n")[2]) == squeeze(texts[number])
        assert r["n_chars"] == len(r["text"])
    assert same == len(rows)


# --- masked language model -------------------------------------------------------


def test_log_probabilities_are_a_distribution():
    shape = masked_lm.Shape(classes=4, members=5, embed=3, hidden=4)
    net = masked_lm.Network(shape, shape.start())
    stream = masked_lm.lay_out(np.array([1, 5, 7], np.int32), np.array([3]), shape.reach)
    total = 0.0
    for token in range(shape.tokens):
        t = stream.tokens.copy()
        t[stream.at[1]] = token
        total += math.exp(net.log_prob(t, stream.at[1:2])[0])
    assert total == pytest.approx(1.0, abs=1e-5)


def test_chunks_of_tokens_do_not_matter(monkeypatch):
    shape = masked_lm.Shape(classes=4, members=5, embed=3, hidden=4)
    net = masked_lm.Network(shape, shape.start())
    stream = masked_lm.lay_out(np.random.default_rng(1).integers(1, 20, 500).astype(np.int32), np.array([0, 200, 1, 299]), shape.reach)
    whole = net.log_prob(stream.tokens, stream.at)
    monkeypatch.setattr(masked_lm, "CHUNK", 37)
    assert net.log_prob(stream.tokens, stream.at) == pytest.approx(whole, abs=1e-5)


def test_training_lowers_the_loss_and_gradients_agree():
    shape = masked_lm.Shape(classes=3, members=4, embed=3, hidden=5)
    rng = np.random.default_rng(2)
    tokens = np.tile(np.array([1, 2, 3, 4, 5, 6], np.int32), 60)
    stream = masked_lm.lay_out(tokens, np.array([len(tokens)]), shape.reach)
    net = masked_lm.Network(shape, shape.start())
    before = net.log_prob(stream.tokens, stream.at).mean()
    memory = {k: np.full_like(v, 1e-4) for k, v in net.p.items()}
    for _ in range(40):
        net.train(stream.tokens, rng.permutation(stream.at), memory, batch=64)
    assert net.log_prob(stream.tokens, stream.at).mean() > before / 4

    # one step's gradient, read back from its memory, against finite differences
    net = masked_lm.Network(shape, {k: v.astype(np.float64) for k, v in shape.start().items()})
    zero = {k: np.zeros_like(v) for k, v in net.p.items()}
    start = {k: v.copy() for k, v in net.p.items()}
    net.train(stream.tokens, stream.at[:32], zero, batch=64)
    for name in ("w1", "w2", "embed", "b1"):
        at = np.unravel_index(np.argmax(zero[name]), zero[name].shape)
        loss = []
        for eps in (1e-4, -1e-4):
            p = {k: v.copy() for k, v in start.items()}
            p[name][at] += eps
            loss.append(-masked_lm.Network(shape, p).log_prob(stream.tokens, stream.at[:32]).mean())
        assert abs((loss[0] - loss[1]) / 2e-4) == pytest.approx(math.sqrt(zero[name][at]), rel=0.02)


def test_scores_of_all_rows(spark, docs):
    model = masked_lm.train_masked_lm(docs)
    rows = masked_lm.score_documents(frame(spark, [(1, None, "en", "s"), (2, "", "en", "s"), (3, "The and of", "en", "s"), (3, "The and of", "en", "s")]), model).collect()
    assert [(r["n_tokens"], r["pll"]) for r in rows[:2]] == [(0, 0.0)] * 2
    assert rows[2]["pll"] == rows[3]["pll"] < 0 and rows[2]["n_tokens"] == 3
    uniform = -math.log(len(model.vocabulary) + model.words.count())  # every distinct word is an outcome
    scored = masked_lm.score_documents(docs, model).agg(F.sum("pll") / F.sum("n_tokens")).first()[0]
    assert scored > uniform + 0.5
    empty = masked_lm.train_masked_lm(frame(spark, []))
    assert empty.vocabulary == [] and masked_lm.score_documents(frame(spark, []), empty).count() == 0


def plain_likelihood(text, model, counts):
    """Sum of log-probabilities, one token after the other, by the definition of the network and of word shares."""
    p, s = {k: v.astype(float) for k, v in model.params.items()}, model.shape
    ids = {w: masked_lm.SPARE + 1 + i for i, w in enumerate(model.vocabulary)}
    words = text.split(" ") if text else []
    shared = lambda w: 1 + masked_lm.hash_of(w.encode()) % masked_lm.SPARE
    token = lambda w: ids.get(w.encode()) or shared(w)
    of_spare = Counter()
    for w, n in counts.items():
        if w.encode() not in ids:
            of_spare[shared(w)] += n
    tokens, total = [0] * s.reach + [token(w) for w in words] + [0] * s.reach, 0.0
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for i, w in enumerate(words):
        near = tokens[i : i + s.reach] + tokens[i + s.reach + 1 : i + 2 * s.reach + 1]
        h = np.tanh(np.concatenate([p["embed"][t] for t in near]) @ p["w1"] + p["b1"])
        cls, member = token(w) % s.classes, token(w) // s.classes
        total += math.log(softmax(h @ p["w2"] + p["b2"])[cls]) + math.log(softmax(h @ p["w3"][cls] + p["b3"][cls])[member])
        if w.encode() not in ids:
            total += math.log(max(counts.get(w, 1), 1) / max(of_spare[shared(w)], 1))
    return len(words), total


def test_scores_equal_brute_force(spark, docs):
    """The query's rows against an independent sum over single tokens, whole texts, for a spread of documents."""
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    counts = Counter(w.decode() for t in texts.values() for w in masked_lm.words_of(t))
    model = masked_lm.train_masked_lm(docs, masked_lm.Shape(classes=8, members=32))
    assert model.words.count() == len(set(counts)) - len(model.vocabulary) > 100
    got = {r["doc_id"]: r for r in masked_lm.score_documents(docs, model).collect()}
    assert len(got) == len(texts)
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[::9]:
        text = " ".join(w.decode() for w in masked_lm.words_of(texts[i]))
        n, total = plain_likelihood(text, model, counts)
        assert got[i]["n_tokens"] == n and got[i]["pll"] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_what_occurs_twice_scores_apart(spark):
    """Counts of the whole corpus tell texts that occur twice from those that occur once, in whatever task they lie."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    common = [word() for _ in range(30)]
    text = lambda: " ".join(rng.sample([*rng.choices(common, k=40), *(word() for _ in range(40))], 80))
    once, twice = [text() for _ in range(120)], [text() for _ in range(20)]
    rows = [(i, t, "en", "s") for i, t in enumerate(once + twice + twice)]
    corpus = frame(spark, rows).repartition(6)
    model = masked_lm.train_masked_lm(corpus, masked_lm.Shape(classes=8, members=12))
    got = {r["doc_id"]: r["pll_per_token"] for r in masked_lm.score_documents(corpus, model).collect()}
    assert min(got[i] for i in range(120, 160)) > max(got[i] for i in range(120))
    assert all(got[i] == got[i + 20] for i in range(120, 140))


def test_every_token_is_trained_on(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (1, 2, 3, 1, 50, 700)] + ["", None]
    model = masked_lm.train_masked_lm(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    assert model.trained == 1 + 2 + 3 + 1 + 50 + 700


# --- mixing ----------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, left = share * sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(out.values())
        level = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if level[s] > cap * sizes[s]}
        if not over:
            return out | level
        out |= {s: cap * sizes[s] for s in over}
        left -= over
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_sharing_the_excess_again_and_again(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice("aAbBzé") + str(i): rng.choice([0, 1, 5, 100, 10_000]) for i in range(rng.randrange(1, 9))} | {None: rng.randrange(50)}
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [3.0, 1.0, 2.0], 1.5, 2.0).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_takes_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), "en", rng.choice(["a", "a", "b", "c", None])) for i in range(400)] + [(None, None, None, "a"), (7, "x y", "en", "b"), (7, "x y", "en", "b")]
    got = mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = defaultdict(list)
    sources = Counter()
    for i, t, _, s in rows:
        sources[s] += len((t or "").split())
    for r in got:
        by[r["target"]].append(r)
    want = plain_targets(dict(sources))
    assert sorted(by) == pytest.approx(sorted(want.values()))
    for target, own in by.items():
        assert sum(r["taken"] for r in own) == math.floor(target)
        # complete epochs first: the times a document is taken differ by one at most
        times = [r["taken"] / r["size"] for r in own if r["size"]]
        assert max(times) - min(times) <= 1
        cut = sorted((r for r in own if r["size"]), key=lambda r: (r["key"], r["doc_id"] if r["doc_id"] is not None else -1, r["size"]))
        assert [r["taken"] / r["size"] for r in cut] == sorted((r["taken"] / r["size"] for r in cut), reverse=True)
    again = mix_sources(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix_sources(frame(spark, [])).count() == 0


def test_weights_pull_documents_forward(spark):
    rows = [(i, "a b c d", "en", "s" if i < 300 else "t") for i in range(330)]
    weight = spark.createDataFrame([(i, 5.0) for i in range(150)], "doc_id long, weight double")
    got = mix_sources(frame(spark, rows), weight, weights=[1.0, 1.0], share=0.9).filter("doc_id < 300").collect()
    heavy = sum(r["taken"] for r in got if r["doc_id"] < 150)
    assert heavy > 0.5 * sum(r["taken"] for r in got)


# --- quality ---------------------------------------------------------------------


def plain_repeats(words, width=8):
    at = defaultdict(list)
    for i in range(len(words) - width + 1):
        at[tuple(words[i : i + width])].append(i)
    return len({j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + width)})


def test_repeats_equal_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
        assert repeated_words(words) == plain_repeats(words)


def test_base_counts():
    text = "a  #b| c\na #b| c\n\n \na #b| c\nx"
    got = dict(zip(quality_votes.FEATURES, features(text)))
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"]) == (10, 16, 6, 1)
    assert features(None) == features("") == (0,) * len(quality_votes.FEATURES)


def test_em_finds_the_better_rules():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    votes = np.stack([np.where(rng.random(4000) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)) for a in (0.95, 0.9, 0.6)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = fit_votes(patterns.astype(float), counts.astype(float), ("a", "b", "c"))
    assert model.accuracy[0] > model.accuracy[2] and abs(model.accuracy[1] - 0.9) < 0.06 and abs(model.prior - 0.7) < 0.08


def plain_quality(rows):
    """(doc_id to p_good) by expectation-maximisation over single documents, from the counts of the query's rows."""
    def votes(r):
        w, lines = max(r["n_words"], 1), max(r["n_lines"], 1)
        pick = lambda bad, good: -1 if bad else 1 if good else 0
        mean, symbols, odd, plain = r["word_chars"] / w, r["n_symbols"] / w, r["n_symbol_words"] / w, r["n_plain_words"] / w
        return [
            pick(mean < 2.5 or mean > 14, False), pick(symbols > 0.3, symbols < 0.1), pick(odd > 0.25, odd < 0.1), pick(plain < 0.6, plain > 0.85),
            pick(r["n_repeat_words"] / w > 0.25, False), pick(r["n_dup_lines"] / lines > 0.3, False), pick(r["n_upper_words"] / w > 0.5, False), pick(r["n_words"] < 20, r["n_words"] >= 60),
        ]

    cast, acc, prior = [votes(r) for r in rows], [0.8] * 8, 0.7
    posterior = lambda v: 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(x * math.log(a / (1 - a)) for x, a in zip(v, acc))))
    for _ in range(200):
        good = [posterior(v) for v in cast]
        new = []
        for k in range(8):
            right = sum(g if v[k] > 0 else 1 - g for g, v in zip(good, cast) if v[k])
            new.append(min(0.98, max(0.55, (right + 0.8) / (sum(1 for v in cast if v[k]) + 1.0))))
        moved = max(abs(a - b) for a, b in zip(new + [sum(good) / len(good)], acc + [prior]))
        acc, prior = new, min(0.95, max(0.05, sum(good) / len(good)))
        if moved < 1e-9:
            break
    return {r["doc_id"]: posterior(v) for r, v in zip(rows, cast)}


def test_quality_equals_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = judge_quality(docs).collect()
    want = plain_quality(rows)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), plain_repeats(words))
        assert r["p_good"] == pytest.approx(want[r["doc_id"]], abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and want[r["doc_id"]] >= 0.5)


def test_counts_of_very_long_texts():
    rng = random.Random(4)
    words = [f"w{rng.randrange(30)}" for _ in range(60_000)]
    got = dict(zip(quality_votes.FEATURES, features("\n".join(" ".join(words[i : i + 7]) for i in range(0, 60_000, 7)))))
    assert (got["n_words"], got["word_chars"], got["n_repeat_words"]) == (60_000, sum(map(len, words)), plain_repeats(words))


def test_quality_verdicts(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op8_quality_votes"](spark, sf_dir).collect()
    assert all(not r["kept"] for r in rows if r["base_failed"])
    fair = [r for r in rows if not r["base_failed"] and r["doc_id"] in labels]
    good = [r["kept"] for r in fair if labels[r["doc_id"]] == 1]
    bad = [r["kept"] for r in fair if labels[r["doc_id"]] == 0]
    assert all(good) and sum(bad) <= 0.2 * len(bad)
    odd = judge_quality(frame(spark, [(1, None, "en", "s"), (None, "", "en", "s"), (1, None, "en", "s")])).collect()
    assert [(r["n_words"], r["base_failed"], r["kept"]) for r in odd] == [(0, True, False)] * 3
    assert judge_quality(frame(spark, [])).count() == 0


# --- URLs ------------------------------------------------------------------------


def test_rules_and_hosts(spark):
    urls = [
        "http://a.example.net/x", "https://A.Example.NET/en/1?q#f", "http://example.com/de/1", "http://notexample.com/de/1", "http://x.org/fr/2", "http://x.org?fr/", "x.org/fr/", None, "ftp://h.net", "http://net/", "a://b://c/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "url string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, none).collect()}
    assert got == {
        0: ("a.example.net", "/x", "net/", "block"),
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("example.com", "/de/1", "example.com/de/", "block"),
        3: ("notexample.com", "/de/1", None, "allow"),
        4: ("x.org", "/fr/2", "org/fr/", "allow"),
        5: ("x.org", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("h.net", "", None, "allow"),
        9: ("net", "/", "net/", "block"),
        10: ("b:", "//c/", None, "allow"),
    }


def test_reputation_shrinks_to_the_domain(spark):
    rows = [(f"http://bad.spam.com/{i}", 1) for i in range(60)] + [(f"http://worse.spam.com/{i}", 1) for i in range(40)]
    rows += [("http://new.spam.com/1", None), ("http://once.spam.com/1", 0)]
    rows += [(f"http://h{i % 20}.fine.org/{i}", int(i % 25 == 0)) for i in range(400)] + [("http://lone.fine.org/", 1)]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    pages = outcomes.select(F.monotonically_increasing_id().alias("page_id"), "url")
    got = {r["host"]: r for r in filter_urls(pages, outcomes, rules=(Rule("allow", "never", "/"),)).collect()}
    assert got["bad.spam.com"]["verdict"] == got["new.spam.com"]["verdict"] == "block"
    assert got["lone.fine.org"]["verdict"] == got["h1.fine.org"]["verdict"] == "allow"
    assert got["new.spam.com"]["bad_bound"] < got["bad.spam.com"]["bad_bound"]
    assert got["lone.fine.org"]["bad_rate"] < 0.5


def test_bad_hosts_are_blocked_on_a_driver_table(spark, sf_dir):
    """With outcomes that go with hosts, pages of the bad ones are blocked, and constant allow is wrong."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    own = pages.withColumn("host", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)))
    biggest = own.filter("host not like '%.net'").groupBy("host").count().orderBy(F.desc("count"), "host").first()["host"]
    bad = F.col("host") == biggest
    outcomes = own.select("url", F.when(F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 < 4, bad.cast("int")).alias("bad"))
    rows = filter_urls(pages, outcomes).filter("rule is null").collect()
    blocked = {r["host"] for r in rows if r["verdict"] == "block"}
    assert biggest in blocked and len(blocked) <= 0.1 * len({r["host"] for r in rows}) + 1
    explicit = filter_urls(pages, outcomes, threshold=1.0, allowed_share=None).filter("rule is null and verdict = 'block'")
    assert explicit.count() == 0


def test_the_query_decides_by_reputation(spark, sf_dir):
    rows = [r for r in QUERIES["op9_url_reputation"](spark, sf_dir).collect() if r["rule"] is None]
    bound = {r["host"]: r["bad_bound"] for r in rows}
    blocked = {r["host"] for r in rows if r["verdict"] == "block"}
    assert blocked and len(blocked) < len(bound) / 2
    assert min(bound[h] for h in blocked) > max(b for h, b in bound.items() if h not in blocked)


def test_suffixes_of_a_table(spark):
    from codeloom.llm.url_reputation import with_domains

    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.y.z.kawasaki.jp",), ("kawasaki.jp",), ("net",), ("",)], "host string")
    table = spark.createDataFrame([("z.kawasaki.jp",), ("jp",), ("CO.UK ",), (None,)], "suffix string")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in with_domains(hosts, table).collect()}
    assert got == {"a.b.co.uk": ("co.uk", "b.co.uk"), "x.y.z.kawasaki.jp": ("z.kawasaki.jp", "y.z.kawasaki.jp"), "kawasaki.jp": ("jp", "kawasaki.jp"), "net": ("net", "net"), "": ("", "")}
    assert {r["host"]: r["suffix"] for r in with_domains(hosts).collect()}["a.b.co.uk"] == "co.uk"


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", "h", "p", 0.5), (1, "http://a.b/x", "h", "p", 0.5)], "page_id long, url string, host string, path string, bad_rate double")
    outcomes = spark.createDataFrame([("http://a.b/y" + "z" * 100_000, 1, "h")], "url string, bad int, host string")
    assert [(r["host"], r["path"], r["verdict"]) for r in filter_urls(pages, outcomes).collect()] == [("a.b", "/x", "block")] * 2


# --- all of them -----------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, sf_dir, name):
    of = {"op4_chat_pairs": ("conversations", "conv_id"), "op5_html_tree": ("pages", "page_id"), "op9_url_reputation": ("pages", "page_id")}
    table, key = of.get(name, ("documents", "doc_id"))
    want = {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().collect()}
    rows = QUERIES[name](spark, sf_dir).select(key).collect()
    assert {r[0] for r in rows} == want and len(rows) == len(want)


def test_sql_says_the_same(spark, sf_dir):
    from codeloom.llm.sql import ORACLE_SQL

    con = oracle.connect(sf_dir)
    for name, sql in ORACLE_SQL.items():
        got, want = oracle.spark_rows(QUERIES[name](spark, sf_dir)), oracle.duck_rows(con, sql)
        assert got[0] == want[0] and got[1] == want[1], name


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from codeloom.llm.common import materialize

    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = start
    ids = [r[0] for r in docs.select("doc_id").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = materialize(stage(spark, docs, sf_dir), name)
        assert new.columns == start.columns
        kept = {r[0] for r in new.select("doc_id").collect()}
        assert kept <= set(ids)
        if name in ("simhash_near_dedup", "decontamination"):
            assert len(kept) < len(ids)
        if name == "suffix_array_dedup":
            assert kept == set(ids)
        docs, ids = new, list(kept)
    last = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in last.collect()} == set(ids)
    taken, target = last.agg(F.sum("taken")).first()[0], last.select("source_size", "target").distinct().agg(F.sum("target")).first()[0]
    assert taken <= target + 1


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15)]
    for rows, where in (([], "none"), (odd, "odd")):
        d = str(tmp_path / where)
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "a b c")] if rows else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        corpus_pipeline.run(spark, d).collect()


ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, _key string, _gone string, _slice int, n_removed int, _doc long, size string, `a b` string"


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, stage by stage."""
    import corpus_pipeline

    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    long, a, b = words(40_000), words(80), words(80)
    rows = [(1, a, "en", "s"), (2, a, None, None), (2, a, None, None), (None, b, "en", "s"), (3, None, "en", "s"), (4, "", "en", "t"), (5, long, "en", "t"), (6, "12 !?", None, "t")]
    extra = lambda i: ("k", f"key {i}", "gone", i, 7, 8, "size", "ab")
    table = spark.createDataFrame([(*r, len(r[1] or ""), *extra(i)) for i, r in enumerate(rows)], ODD)
    spark.createDataFrame([(1, " ".join(b.split()[:12])), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1, None), (5, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {
        "language_id": [0, 1, 2, 3, 6],  # no letters: nulls, empty texts and row 7 go
        "simhash_near_dedup": [0, 3, 4, 6, 7],  # row 5 is like row 4, both without words; null id 3 is alone
        "suffix_array_dedup": list(range(8)),
        "decontamination": [0, 1, 2, 4, 5, 6, 7],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        got = out.collect()
        assert out.columns == table.columns, name
        assert sorted(r["_slice"] for r in got) in ([want[name]] if name != "simhash_near_dedup" else [want[name], [0, 3, 4, 6, 7]]), name
        for r in got:  # other columns are those of the row
            assert (r["key"], r["_key"], r["_gone"], r["n_removed"], r["_doc"], r["size"], r["a b"]) == ("k", f"key {r['_slice']}", "gone", 7, 8, "size", "ab")
            if name != "suffix_array_dedup":
                assert r["text"] == rows[r["_slice"]][1]
        if name == "suffix_array_dedup":
            texts = {r["_slice"]: (r["text"], r["n_chars"]) for r in got}
            assert texts[0] == (a, len(a)) and texts[1] == texts[2] == ("", 0) and texts[4] == (None, 0) and texts[6] == (long, len(long))
        assert stage(spark, table.limit(0), str(tmp_path)).columns == table.columns and stage(spark, table.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.source_mixing(spark, table, str(tmp_path))
    taken = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["taken"] <= 2 * r["size"]) for r in last.collect()), key=str)
    assert [t[0] for t in taken] == sorted([1, 2, 2, -1, 3, 4, 5, 6], key=str) and all(t[1] for t in taken)
    assert corpus_pipeline.source_mixing(spark, table.limit(0), str(tmp_path)).count() == 0


def test_stages_decide_by_row(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    # texts of letters that differ far more than near-duplicates do
    a, b, c, d = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(4))

    def kept(stage, rows):
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, frame(spark, [(i, t, "en", "s") for i, t in rows]), str(tmp_path)).collect()), key=str)

    # language ID: a text without letters takes no other row of its doc_id along
    assert kept(corpus_pipeline.language_id, [(None, a), (None, ""), (None, None), (7, b), (7, "12"), (8, c)]) == sorted([(None, a), (7, b), (8, c)], key=str)

    # near-dedup: one row of each group, repeated and null ids included
    rows = [(5, a), (6, a), (4, b), (5, b), (None, c), (None, c), (9, d), (9, d), (None, d)]
    assert kept(corpus_pipeline.simhash_near_dedup, rows) == sorted([(5, a), (4, b), (None, c), (9, d)], key=str)

    # decontamination: only the row with the benchmark's words goes
    spark.createDataFrame([(1, " ".join(a.split()[10:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, a), (None, b), (3, a), (3, c)]
    assert kept(corpus_pipeline.decontamination, rows) == sorted([(None, b), (3, c)], key=str)
