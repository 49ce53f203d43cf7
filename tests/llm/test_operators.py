"""The operators against brute force on small tables: whole results, nulls, empty tables, ties, clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, connect
from formloom.llm import htmltext, jaccard, mixing, pieces, pii, quality, queries, repeats, revisits, suffixes, syncmers, toxicity
from formloom.plans.catalog import Entry

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score string, copies int, key string, g int, x0 int, part int, spans int"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(20_000))
PASSAGE = "this very passage of more than fifty bytes is found in several of the documents, word by word"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (13 - len(r))) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, copies, near copies, repeated rows and ids."""
    near = " ".join(f"n{i}" for i in range(60))
    return docs_of(spark, [
        (1, None, None, None, None), (None, "no id here", "en", "a", 10), (None, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 4),
        (4, near, "en", "a", 1), (5, near.replace("n30 ", "changed "), "en", "a", 1), (6, near, "en", "b", 1), (6, near, "en", "b", 1), (7, LONG, "de", "c", 1),
        (8, "one two", "en", "a", 7), (9, "one two", "en", "a", 7), (10, f"start {PASSAGE} end", "en", "b", 1), (11, f"{PASSAGE}", "en", "b", 1),
        (12, "mail me at x.y@example.com or 10.0.0.1 or +1 (234) 555-7890", "en", "b", 1), (13, "a\n\na\na b\na b \n" + "z " * 60, "fr", "c", 1),
    ])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def local(df):
    return df.collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    count, ok, why = compare(spark, connect(SF), Entry(queries.QUERIES[name], queries.ORACLES[name]), SF)
    assert ok, why
    assert count > 0


# --- personal data


def base_spans(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(pii.BASE[kind], text or ""):
            digits = [int(c) for c in m.group() if c.isdigit()]
            mirrored = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
            fine = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and sum(mirrored) % 10 == 0, "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base(spark, sample, odd, none):
    for docs in (sample, odd):
        rows, base, every = pii.with_spans(docs)
        got = rows.select("text", pii.joined(F.col(base)).alias("b"), pii.joined(F.col(every)).alias("e")).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r.b == base_spans(r.text)
            assert set(filter(None, r.b.split(","))) <= set(r.e.split(","))
    assert pii.masked(none).count() == 0
    masked = {r.doc_id: r for r in local(pii.masked(odd).filter("doc_id = 12 or doc_id = 2"))}
    assert masked[12].text == "mail me at [email] or [ip] or [phone]"
    assert masked[12].n_chars == len(masked[12].text) and masked[2].text == ""
    assert pii.masked(odd).columns == odd.columns


def test_pii_names_and_many_spans(spark):
    """Columns with the names of inner ones stay, and a text with thousands of spans is rebuilt in one pass."""
    many = " ".join(f"u{i}@example.com" for i in range(20_000))
    docs = spark.createDataFrame([(1, many, "a", "b"), (2, None, "a", "b"), (3, "nothing", None, "b")], "doc_id bigint, text string, __id string, own_digest_ string")
    got = {r.doc_id: r for r in pii.masked(docs).collect()}
    assert pii.masked(docs).columns == docs.columns
    assert got[1].text == " ".join(["[email]"] * 20_000) and got[2].text is None and got[3].text == "nothing"
    assert (got[1]["__id"], got[1]["own_digest_"], got[3]["__id"]) == ("a", "b", None)


def test_pii_learns(spark):
    """Cards behind "card number" are seeds; what follows the same words and fails as a card is found by them."""
    card = lambda i: next(c for d in range(10) if pii.luhn(c := f"41111111{i:07d}{d}"))
    rows = [(i, f"please use card number {card(i)} today") for i in range(20)] + [(99, "please use card number AC-7781234 today"), (100, "room AC-7781234 only")]
    rows, base, every = pii.with_spans(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r.doc_id: r.e for r in rows.select("doc_id", pii.joined(F.col(every)).alias("e")).collect()}
    assert got[99] == "card:23:33" and got[100] == ""


def test_pii_second_hop(spark):
    """Identifiers found beside seeds make the next context count, and those found there the one after it."""
    card = lambda i: next(c for d in range(10) if pii.luhn(c := f"41111111{i:07d}{d}"))
    texts = [f"use card number {card(i)}" for i in range(30)] + [f"use card number AA-{i:05d}" for i in range(8)]
    texts += [f"see member code AA-{i:05d}" for i in range(8)] + [f"see member code BB-{i:05d}" for i in range(5)]
    texts += [f"old account key BB-{i:05d}" for i in range(5)] + ["old account key CC-00001", "some other word CC-00001"]
    rows, base, every = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r.text: r.e for r in rows.select("text", pii.joined(F.col(every)).alias("e")).collect()}
    assert all(got[t] == ("" if "other" in t else f"card:16:{len(t)}") for t in texts)


def test_pii_every_token(spark):
    """Tokens with a digit or an @ of any length are mentions, also where a text begins or behind long words."""
    long, other = "x" * 3000, "y" * 3000
    find = pii._finder()
    assert {(m[3], m[4]) for m in find("7 a@b\nis my 8 (c) @ x9")[1]} == {("7", " "), ("a@b", " 7"), ("8", "is my"), ("@", "8 (c)"), ("x9", "(c) @")}
    texts = [f"mail u{i}@example.com" for i in range(10)] + ["mail jane@localhost"]
    texts += [f"v{i}@example.com opens" for i in range(10)] + ["j@intranet opens", "z@intranet opens"]
    texts += [f"{long} is w{i}@example.com" for i in range(10)] + [f"{long} is 7", f"{other} is 8"]
    rows, base, every = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r.text: r.e for r in rows.select("text", pii.joined(F.col(every)).alias("e")).collect()}
    assert got["mail jane@localhost"] == "email:5:19" and got["j@intranet opens"] == "email:0:10"
    assert got[f"{long} is 7"] == "email:3004:3005" and got[f"{other} is 8"] == ""
    dense = " ".join(["k", "-".join(f"10.0.{i % 250}.{i % 249}x@" for i in range(30_000))])
    found = find(dense)[1]
    assert len({m[4] for m in found}) == len({m[1] for m in found}) > 30_000


# --- quality


def statistics(text):
    words = WORDS.findall(text or "")
    grams = list(zip(words, words[1:], words[2:], strict=False))
    many = collections.Counter(grams)
    held = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(held)


def test_quality_statistics(odd, sample, none):
    for docs in (odd, sample):
        rows, n = quality.base_statistics(docs)
        for r in rows.collect():
            assert tuple(r[n[c]] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == statistics(r.text)
        judged, names = quality.judge(docs)
        got = judged.collect()
        assert len(got) == docs.count()
        for r in got:
            assert r[names["base_failed"]] == (r[names["n_words"]] < 50 or 100 * r[names["n_repeat_words"]] > 50 * r[names["n_words"]])
            assert not (r[names["base_failed"]] and r[names["kept"]])
    assert quality.judge(none)[0].count() == 0


def test_quality_outliers(spark):
    """Plain texts stay, texts full of symbols go, though they are a tenth of their group."""
    rng = random.Random(1)
    plain = lambda: " ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(80, 300)))
    rows = [(i, plain() if i % 10 else re.sub(" ", "*** ", plain()), "en", "a") for i in range(300)]
    judged, n = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    got = {r.doc_id: r[n["kept"]] for r in judged.collect()}
    assert all(not got[i] for i in range(0, 300, 10)) and sum(got[i] for i in range(300) if i % 10) >= 268


def test_quality_each_dimension(spark):
    """An outlier in one statistic alone goes, whichever of the five it is; single chance symbols, copies and repeats stay."""
    rng = random.Random(2)
    word = lambda a=2, b=9: "".join(rng.choice("etaoinsh") for _ in range(rng.randint(a, b)))
    lines = lambda n, m, **k: [[word(**k) for _ in range(rng.randint(m - 3, m + 3))] for _ in range(n)]
    plain = lambda: lines(rng.randint(10, 20), 12)
    text = lambda x: "\n".join(" ".join(w) for w in x)
    odd = {"symbols": plain(), "copies": plain(), "repeats": plain(), "line": lines(3, 120), "word": lines(12, 12, a=7, b=12)}
    odd["symbols"] = [[w + "*" * (i % 5 == 0) for i, w in enumerate(x)] for x in odd["symbols"]]
    odd["copies"] = [y for i, x in enumerate(odd["copies"]) for y in (x, ["ab"] if i % 2 else [word()])]
    odd["repeats"] = [[*x[:6], "one", "two", "three", "four"] for x in odd["repeats"]]
    chance = [plain() for _ in range(3)]
    chance[0][0][0] += "*"
    chance[1][5][:3] = chance[1][8][:3] = ["one", "two", "three"]
    for i in (3, 8):  # their words go to the next line
        chance[2][i + 1] += chance[2][i]
        chance[2][i] = ["ab"]
    rows = [*[(f"p{i}", text(plain())) for i in range(300)], *[(f"c{i}", text(x)) for i, x in enumerate(chance)], *[(k, text(x)) for k, x in odd.items()]]
    judged, n = quality.judge(spark.createDataFrame([(*r, "en", "a") for r in rows], "doc_id string, text string, lang string, source string"))
    got = {r.doc_id: r for r in judged.collect()}
    assert not any(got[k][n["base_failed"]] for k in odd)
    assert {k for k in odd if got[k][n["kept"]]} == set()
    assert all(got[f"c{i}"][n["kept"]] for i in range(3)) and sum(got[f"p{i}"][n["kept"]] for i in range(300)) >= 295


# --- pages


def test_blocks():
    page = (
        '<body>Hi &lt;b&gt;<div class="side sidebar">x<div>y</div>z</div>rest<br>more<p>para<header>top</header><article><header><h1>T</h1></header>'
        '<p>a &amp;  b<p>c<ul class="comments"><li>no</ul><div>d</div><article class="comment"><p>no</p></article>e</article>tail<script>if(a<b){}</script><!-- x -->'
    )
    assert [b for b in htmltext.blocks_of(page) if b[0] != "chrome"] == [
        ("open", "Hi <b>"), ("open", "rest more"), ("open", "para"), ("text", "T"), ("text", "a & b"), ("text", "c"), ("text", "d"), ("text", "e"), ("open", "tail"),
    ]


@pytest.mark.parametrize(("page", "want"), [
    ("<head><title>t</title><meta charset=x><body><article><p>main text</article>", ["main text"]),
    ("<html><head><title>t</title><link rel=x><p>main text", ["main text"]), ("<head><title>t</title>main text", ["main text"]),
    ('<article><p class="notice">x<p>main <b>text</b><p>more</article>', ["main text", "more"]),
    ('<article><ul><li class="ad">x<li>one<li class="ad">y</ul>main text</article>', ["one", "main text"]),
    ('<article><ul><li class="ad"><ul><li>in<li>in</ul>x<li>one</ul></article>', ["one"]),
    ('<article><dl><dt class="ad">x<dd>one<dt class="ad">y</dl>main text</article>', ["one", "main text"]),
    ('<article><table><tr class="ad"><td>x<td>y<tr><td class="ad">z<td>one</table>main text</article>', ["one", "main text"]),
    ('<article><div><p class="ad">x</div>main text</article>', ["main text"]), ("<article><div><button>x</div>main text</article>", ["main text"]),
    ("<article><form><select><option>x<option>y</form><p>main text</article>", ["main text"]),
    ("<article><button>x<div>y</div>z</button>main text</article>", ["main text"]), ('<article><b><div class="ad">x</b>y</div>main text</article>', ["main text"]),
])
def test_omitted_end_tags(page, want):
    assert [text for kind, text in htmltext.blocks_of(page) if kind != "chrome"] == want


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in htmltext.extracted(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        lines = (re.sub(r"\s+", " ", htmltext.html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        text = "\n".join(x for x in lines if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (text, len(text))


def test_host_boilerplate(spark):
    """Without article marks, what pages of a host share goes and unique runs stay; copies of a page keep their text."""
    shared = "all rights reserved by the owner of this site since the year one"
    own = lambda i: " ".join(f"t{i}w{j}" for j in range(30))
    rows = [(i, f"http://a.example/{i}", f"<div>{own(i)}</div><div>{shared}</div>") for i in range(5)]
    rows += [(10 + i, "http://b.example/", f"<div>{own(9)}</div><div>{shared}</div>") for i in range(3)] + [(None, None, None), (20, "x", "")]
    got = {r.page_id: r for r in htmltext.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i].text for i in range(5)] == [own(i) for i in range(5)]
    assert {got[10 + i].text for i in range(3)} == {f"{own(9)}\n{shared}"}
    assert (got[None].text, got[20].text, got[20].n_chars) == ("", "", 0)
    assert htmltext.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# --- near duplicates


def classes(rows):
    """Class and links of each row by index, from all pairs."""
    sets = []
    for _, text in rows:
        w = WORDS.findall(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, least.get(find(i)), links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def test_jaccard(spark, odd, sample, none):
    for docs in (odd, sample.limit(200)):
        got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.joined(docs).collect()), key=repr)
        assert got == classes([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.joined(none).count() == 0
    kept = sorted((r.doc_id for r in jaccard.one_of_each(odd).collect()), key=repr)
    assert kept == sorted([1, None, None, 2, 3, 4, 7, 8, 10, 12, 13], key=repr)


def test_jaccard_blocks(spark, monkeypatch):
    """A cluster in many blocks gives the links that one block gives."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == classes(rows)


def test_posterior():
    """The least number of agreeing values by numerical integration of the posterior."""
    t = np.linspace(0.0005, 0.9995, 1000)
    for n in (40, 80, 240):
        m = jaccard.needed(n)
        for k, wanted in ((m, True), (m - 1, False)):
            density = k * np.log(t) + (n - k) * np.log(1 - t)
            density = np.exp(density - density.max())
            assert (density[t >= 0.8].sum() / density.sum() >= jaccard.TOLERANCE * 0.8) == wanted or not wanted


# --- toxicity


def test_toxicity(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7)))
    bad = ["zqidiot", "vwscum", "kjtrash"]
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(5, 90))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(1000, None), (1001, " \n"), (None, "some words")]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scored, name = toxicity.scored(docs, marks)
    got = {r.doc_id: r[name] for r in scored.collect()}
    assert len(got) == 603 and got[1000] == got[1001] == 0.0
    out = [r.doc_id for r in docs.filter(toxicity.held_out(F.col("doc_id"))).collect()]
    right = sum((got[i] >= toxicity.CUT) == bool(dict(labels)[i]) for i in out)
    assert right / len(out) > 0.95
    clash = docs.withColumn("score", F.lit("mine"))
    again, other = toxicity.scored(clash.limit(3), marks.filter("toxic = 0"))
    assert other != "score" and {r[other] for r in again.collect()} <= {0.0}
    assert toxicity.scored(docs.limit(0), marks.limit(0))[0].count() == 0


def test_toxicity_long_words(spark):
    """Every trigram of an overlong word stands in exactly one piece, and a late toxic passage of an unspaced text counts."""
    for n in (62, 63, 64, 70, 71, 72, 73, 200, 10_001):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        parts = toxicity.words_of(word)
        want = {f"<{word}>"[i : i + 3] for i in range(n)}
        got = [r for p in parts for r in toxicity.runs_of(p) if len(r) == 3]
        assert sorted(got) == sorted(want) and max(map(len, parts)) <= 62
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7)))
    bad = ["zqidiot", "vwscum", "kjtrash"]
    rows, labels = [], []
    for i in range(800):
        words = [word() for _ in range(rng.randint(60, 90))]
        toxic = i % 2
        if toxic:
            words[40:40] = [rng.choice(bad) for _ in range(6)]
        rows.append((i, ("", "_", "\u3000", "\u00a0")[i // 2 % 4].join(words)))
        labels.append((i, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scored, name = toxicity.scored(docs, marks)
    out = scored.filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum((r[name] >= toxicity.CUT) == bool(r.doc_id % 2) for r in out) / len(out) > 0.9


def test_network_gradient():
    """The slopes that training uses, against differences of the loss."""
    rng = np.random.default_rng(1)
    m = {k: v.astype(np.float64) for k, v in toxicity.fresh_model({}, {}).items()}
    inputs, real = rng.standard_normal((3, 5, 6 * toxicity.HIDDEN)), np.arange(5) < np.array([[5], [3], [1]])
    logit, kept = toxicity.forward(m, inputs, real, keep=True)
    g, d_inputs = toxicity.backward(m, inputs, kept, np.ones(3))
    for name, place in (("state", (0, 1, 2)), ("state", (1, 3, 17)), ("look", (2, 1)), ("query", (3,)), ("out", (4,))):
        m[name][place] += 1e-4
        up = toxicity.forward(m, inputs, real).sum()
        m[name][place] -= 2e-4
        down = toxicity.forward(m, inputs, real).sum()
        m[name][place] += 1e-4
        assert abs((up - down) / 2e-4 - g[name][place]) < 2e-2 * max(1, abs(g[name][place]))


# --- fingerprints


def test_fingerprints(odd, sample, none):
    f = lambda t: syncmers.smallest(*syncmers.anchors(syncmers.codes_of(t)))
    for docs in (odd, sample):
        order = sorted(((r.doc_id is None, -(r.doc_id or 0), r.text or "", r.doc_id) for r in docs.collect()))
        want = []
        for i, (_, _, text, doc_id) in enumerate(order):
            after, n = order[(i + 1) % len(order)][2], len(text)
            edited = text[: n - n // 2] + after[: n // 2]
            digest = hashlib.sha256(edited.encode()).hexdigest()
            want.append((doc_id, n, digest, syncmers.printed(f(text)), syncmers.printed(f(edited)), syncmers.likeness(f(text), f(edited)), syncmers.likeness(f(text), f(after))))
        assert sorted(map(tuple, syncmers.fingerprints(docs).collect()), key=repr) == sorted(want, key=repr)
    assert syncmers.fingerprints(none).count() == 0


def test_anchors_have_no_context():
    rng = random.Random(2)
    core = "".join(rng.choice("abcdefgh ") for _ in range(300))
    at, h = syncmers.anchors(syncmers.codes_of(core))
    moved, other = syncmers.anchors(syncmers.codes_of("prefix!" + core + "suffix?"))
    assert set(zip((at + 7).tolist(), h.tolist(), strict=True)) <= set(zip(moved.tolist(), other.tolist(), strict=True))


def test_whole_fingerprints():
    """All anchors of a long text are printed, a passage shared by long texts is seen, and a small edit changes the fingerprint."""
    rng = random.Random(7)
    f = lambda t: syncmers.smallest(*syncmers.anchors(syncmers.codes_of(t)))
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, two, passage = text(100_000), text(100_000), text(300)
    at, h = syncmers.anchors(syncmers.codes_of(one))
    assert set(syncmers.printed(f(one)).split(" ")) == {f"{x:016x}@{a:x}" for a, x in zip(at.tolist(), h.tolist(), strict=True)}
    assert syncmers.likeness(f(one[:50_000] + passage), f(two[:70_000] + passage)) > 0
    assert 0.99 < syncmers.likeness(f(one), f(one[:60_000] + "edited" + one[60_006:])) < 1
    assert syncmers.likeness(f(one), f(one[50_000:] + one[:50_000])) < 0.51
    assert len(syncmers.printed(f("a" * 100)).split(" ")) == 81


# --- pieces


def test_pieces_equal_library(odd, sample, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(4)
    tables = pieces.load()
    texts = ["", "  ", " lead", "trail  ", "a\tb\nc", "日本語 テキスト", "🙂👍🏽 ok", "\x00a", "x" + " " * 31 + "\n" + " " * 15, "a" * 300, LONG]
    texts += ["".join(rng.choice("abcdeéß日 \nx12.,") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, ids in zip(texts, pieces.encode_texts(pieces.Encoder(tables), texts), strict=True):
        assert ids.tolist() == model.encode(text)
        assert pieces.decode_ids(tables.pieces, ids) == text
    rows, name = pieces.encoded(odd)
    for r in rows.join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert list(r[name["token_ids"]]) == model.encode(r.text or "") and r[name["round_trip"]]
    assert pieces.encoded(none)[0].count() == 0


# --- repeats


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(400):
        codes = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 60))).astype(np.uint8)
        array = suffixes.suffix_array(codes)
        assert list(array) == sorted(range(len(codes)), key=lambda i: bytes(codes[i:]))
        long = suffixes.common_at_least(codes, array, 9)
        alike = [i > 0 and len(a := bytes(codes[array[i] :])[:9]) == 9 and a == bytes(codes[array[i - 1] :])[:9] for i in range(len(array))]
        assert list(long) == alike


def removals(rows):
    rows = sorted(rows, key=lambda r: repeats.LAST_ID if r[0] is None else r[0])
    first = {}
    for doc_id, text in rows:
        b = (text or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], repeats.LAST_ID if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        off = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (repeats.LAST_ID if doc_id is None else doc_id):
                off[k + 1 : k + 51] = True
        rest = bytes(c for c, o in zip(b, off[1:-1], strict=True) if not o)
        out.append((doc_id, len(b), int(off.sum()), int((off[1:] & ~off[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, odd, sample, none):
    rng = random.Random(6)
    hard = [(i, "".join(rng.choice(["ab", "é", PASSAGE[:60], PASSAGE[20:], "aaaa" * 20, "q"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    same = [(3, PASSAGE + "x"), (3, "y" + PASSAGE), (3, PASSAGE + "x"), (-5, PASSAGE[9:] + "z"), (7, "short"), (8, "short"), (9, PASSAGE[9:] + "z"), (None, PASSAGE)]
    for docs in (odd, sample, *[spark.createDataFrame(r, "doc_id bigint, text string") for r in ([*hard, (None, PASSAGE)], same)]):
        assert sorted(map(tuple, repeats.removed(docs).collect()), key=repr) == removals([(r.doc_id, r.text) for r in docs.collect()])
    assert repeats.removed(none).count() == 0


# --- revisits


def test_revisits(spark):
    rows = [
        (1, "http://www.A.com:80/x/?b=1&a=2&utm_source=q#f", 10, "response", {"etag": '"1"', "server": "s"}, "d1"),
        (2, "https://a.com/x?a=2&b=1", 20, "revisit", {"etag": 'W/"1"', "date": "t", "content-length": "0"}, None),
        (3, "https://a.com/x?a=2&b=1", 9_000_000, "revisit", {"etag": '"2"'}, None), (4, "https://a.com/x?a=2&b=1", 5, "revisit", {"etag": '"1"'}, None),
        (5, "https://a.com/x?a=2&b=1", 30, "revisit", None, None), (6, None, 30, "revisit", None, None), (None, "u", 1, "revisit", None, None),
    ]
    captures = spark.createDataFrame(rows, "record_id bigint, url string, fetched_at bigint, kind string, headers map<string,string>, digest string")
    got = {r.record_id: r for r in revisits.resolved(captures).collect()}
    assert {k: (r.refers_to, r.status, r.digest) for k, r in got.items()} == {
        2: (1, "resolved", "d1"), 3: (1, "mismatch", None), 4: (None, "missing", None), 5: (1, "unchecked", None), 6: (None, "missing", None),
    }
    assert got[2].headers == {"etag": 'W/"1"', "server": "s", "date": "t"}
    assert revisits.resolved(captures.limit(0)).count() == 0


# --- mixing


def test_mixing(spark, odd, none, sample):
    mixed, n = mixing.mix(odd)
    assert n["size"] != "size" and mixed.count() == odd.count()
    for r in mixed.collect():
        assert 0 <= r[n["copies"]] <= 3 and r[n["size"]] == len(WORDS.findall(r.text or ""))
    assert mixing.emitted(none).count() == 0
    mixed, n = mixing.mix(sample)
    rows = mixed.collect()
    total = sum(r[n["size"]] for r in rows)
    aims = {r.source: r[n["target"]] for r in rows}
    assert abs(sum(aims.values()) - total) < 1e-3 * total
    for s, aim in aims.items():
        own = [r for r in rows if r.source == s]
        assert abs(sum(r[n["copies"]] * r[n["size"]] for r in own) - aim) <= 2 * max(r[n["size"]] for r in own)


# --- pipeline


def test_pipeline(spark, sample, tmp_path):
    docs = sample
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.kept(stage(spark, docs, SF))
        assert after.columns == docs.columns
        before = {r.doc_id: r for r in docs.collect()}
        rows = after.collect()
        if name == "near_duplicates":
            found = classes([(d, r.text) for d, r in before.items()])
            assert sorted(r.doc_id for r in rows) == sorted({c for _, c, _ in found})
        elif name == "personal_data":
            assert sorted(r.doc_id for r in rows) == sorted(before)
            for r in rows:
                assert ("[email]" in r.text) >= ("email:" in base_spans(before[r.doc_id].text)) and r.n_chars in (len(r.text), before[r.doc_id].n_chars)
        else:
            assert {r.doc_id for r in rows} <= set(before)
        docs = after
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_odd(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.kept(stage(spark, docs, SF))
            assert name == "pieces" or docs.columns == odd.columns
