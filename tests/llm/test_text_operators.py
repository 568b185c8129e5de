"""Language, personal data, toxicity, licences, HTML: results, and odd rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from floetrack.llm import bytesview, htmltext, langid, licences, pii, queries, toxicity

ODD = "doc_id long, text string, lang string, score string, extra int"


def odd(spark, texts):
    """Rows with an extra column, and one whose name a result uses."""
    return spark.createDataFrame([(i if t != "noid" else None, t, "en", "x", i) for i, t in enumerate(texts)], ODD)


# ---- words as bytes ------------------------------------------------------------------------------
def test_words_match_a_pattern():
    import pyarrow as pa

    from floetrack.llm.decontaminate import WORD_BYTES

    rng = random.Random(1)
    texts = [None, "", "A", "a-b C9é", "x" * 5000] + ["".join(rng.choice("aB9é -\n_ß…") for _ in range(rng.randrange(60))) for _ in range(200)]
    ids, seen = {}, []
    for a, b, raw, offsets in bytesview.text_chunks(pa.array(texts), 300):
        terms, which, first = bytesview.words(raw, offsets, WORD_BYTES)
        for row in range(a, b):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[row] or "")
            want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            got = terms[first[row - a] : first[row - a + 1]].tolist()
            assert len(want) == len(got) and (which[first[row - a] : first[row - a + 1]] == row - a).all()
            for w, g in zip(want, got):
                assert ids.setdefault(w, g) == g
        seen += range(a, b)
    assert seen == list(range(len(texts))) and len(set(ids.values())) == len(ids)


# ---- languages -----------------------------------------------------------------------------------
def test_language_held_out(spark, small):
    got = queries.op1_naive_bayes_language(spark, small).join(queries.table(spark, small, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    own = got[got.held_out]
    assert (own.lang == own.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()


def test_language_counts_match_brute_force(spark):
    rows = spark.createDataFrame([("ab c", "x"), ("abé", "x"), ("zz", "y"), (None, "y"), ("q", None)], "text string, lang string")
    langs, model = langid.fit(rows)
    assert langs == ["x", "y"] and model.shape == (langid.BUCKETS + 1, 2)
    assert np.exp(model[:-1]).sum(axis=0) == pytest.approx([1, 1]) and np.exp(model[-1]) == pytest.approx([2 / 3, 1 / 3])
    total = 0
    for text in ("ab c", "abé"):
        s = text + " "
        total += sum(len(s) - n + 1 for n in langid.ORDERS if len(s) >= n)
    got = sum(len(b) for raw in (b"ab c", "abé".encode()) for b, _, _ in langid.grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    assert got == total


def test_language_odd_rows(spark):
    model = langid.fit(spark.createDataFrame([("the thing and", "en"), ("der die das und", "de")], "text string, lang string"))
    texts = [None, "", "123 !?", "the and the", "the and the", "und das " * 40_000, "noid"]
    got = langid.predict(odd(spark, texts), model).collect()
    assert [r.lang_pred for r in got][:6] == ["und", "und", "und", "en", "en", "de"] and got[0].score == 0.0 and got[3].score == got[4].score
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "score", "extra", "lang_pred"} and len(got) == 7
    empty = odd(spark, ["a"]).where("false")
    assert langid.predict(empty, model).count() == 0 and langid.fit(empty)[0] == []
    assert {r.lang_pred for r in langid.predict(odd(spark, texts), langid.fit(empty)).collect()} == {"und"}


# ---- personal data -------------------------------------------------------------------------------
BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 12 <= len(d := re.sub("[ -]", "", s)) <= 19 and pii.luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def by_pattern(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m[0])]
    return [(name, a, b) for a, _, b, name in sorted(found)]


@pytest.mark.parametrize("alphabet", ["12.5 -", "a@b.c-", "+1(2) .9-", "a1@.+ -é25", "4 -0"])
def test_base_spans_match_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert [s for s in pii.spans(text) if s[0] in pii.KINDS[:4]] == by_pattern(text), text


def test_base_spans_of_documents(spark, small):
    docs = {r.doc_id: r.text for r in queries.table(spark, small, "documents").collect()}
    for r in queries.op2_anchor_pii(spark, small).collect():
        want = by_pattern(docs[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.n_email == sum(k == "email" for k, _, _ in want)


def test_added_spans_and_odd_rows(spark):
    assert pii.spans("IBAN: GB82 WEST 1234 5698 7654 32.") == [("account", 6, 33)]
    assert pii.spans("IBAN: GB83 WEST 1234 5698 7654 32.") == [] and pii.spans("ssn 123-45-6789") == [("account", 4, 15)]
    assert ("url", 3, 28) in pii.spans("at https://example.org/~user1 x"[:28] + " x") or pii.spans("see https://example.org/users/bob now")[0][0] == "url"
    assert pii.spans("https://example.org/menu") == []
    texts = [None, "", "a@b.cd", "a@b.cd", "é" * 200_000 + " me@ex.org", "1" * 5000, "noid"]
    got = pii.detect(odd(spark, texts).withColumn("pii", F.lit(1))).collect()
    assert [len(r.pii) for r in got] == [0, 0, 1, 1, 1, 0, 0] and got[4].pii[0].start == 200_001
    assert pii.detect(odd(spark, texts).where("false")).count() == 0
    assert [r.text for r in pii.mask(odd(spark, texts)).collect()][:3] == [None, "", "<email>"]


# ---- toxicity ------------------------------------------------------------------------------------
def make_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubdfghlmnrst") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    bad = ["zvqual", "zvquen", "xxtroll"]
    texts, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 200))]
        if i % 4 == 0:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(bad) + rng.choice(["", "a", "os"]))
        texts.append(" ".join(own))
        labels.append(int(i % 4 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def toxic_model():
    texts, labels = make_texts(240)
    return toxicity.train(texts, labels, steps=120)


def chunk(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_toxicity_learns_and_covers_whole_texts(toxic_model):
    texts, labels = make_texts(200, 6)
    got = toxicity.scores(toxic_model, *chunk(texts)) >= 0.5
    assert (got == np.array(labels, bool)).mean() >= 0.95
    clean = " ".join(t for t, y in zip(texts, labels) if not y)[:30_000]
    late = clean + " zvqual xxtroll zvquenos zvqual"
    assert toxicity.scores(toxic_model, *chunk([late]))[0] >= 0.5
    one = [toxicity.scores(toxic_model, *chunk([t]))[0] for t in texts[:20]]
    assert np.allclose(one, toxicity.scores(toxic_model, *chunk(texts))[:20], atol=1e-5)


def test_windows_overlap_and_cover():
    words = toxicity.Words(*chunk(["a " * 100, "", "b " * 32, "c " * 33]))
    spots, text = words.windows()
    assert np.bincount(text, minlength=4).tolist() == [4, 0, 1, 2]
    for i, n in enumerate((100, 0, 32, 33)):
        own = spots[text == i]
        assert len(np.unique(own[own < len(words)])) == n


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(rng).items()}
    words = toxicity.Words(*chunk(["one two three " * 6, "four five"]))
    spots, _ = words.windows()
    spots = np.concatenate([spots, spots[:, ::-1]])
    label, bag = np.array([1.0, 0.0]), np.array([0, 1, 0, 1])

    def loss(q):
        z = toxicity.window_logits(q, words, spots).astype(np.float64)
        z = np.log([np.exp(z[bag == i]).sum() for i in range(2)])
        return float((np.log1p(np.exp(z)) - label * z).mean())

    g = toxicity._gradients(p, words, spots, bag, label)
    for name in ("fx", "bh", "a", "av", "o", "word", "gram", "head4"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-3, rel=0.05, abs=2e-4), name


def test_toxicity_odd_rows(spark, toxic_model):
    texts = [None, "", "...", "zvqual zvqual xxtroll", "zvqual zvqual xxtroll", "noid"]
    got = toxicity.predict(odd(spark, texts), toxic_model).collect()
    prior = float(toxic_model["prior"][0])
    assert [r.score for r in got][:3] == pytest.approx([prior] * 3, abs=1e-4) and got[3].predicted == 1 and got[3].score == got[4].score
    empty = odd(spark, texts).where("false")
    assert toxicity.predict(empty, toxic_model).count() == 0
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.predict(odd(spark, texts), none).collect()] == [0] * 6
    assert toxicity.train(["a b"], [1])["prior"][0] == pytest.approx(0.75)


def test_toxicity_scores_match_a_plain_network(toxic_model):
    p, sigmoid = {k: v.astype(np.float64) for k, v in toxic_model.items()}, lambda x: 1 / (1 + np.exp(-x))
    texts = ["zvqual once more", "Four five six, é!", " ".join(f"w{i}" for i in range(70))]
    for t, got in zip(texts, toxicity.scores(toxic_model, *chunk(texts)), strict=True):
        words = toxicity.Words(*chunk([t]))
        x = words.inputs(p)
        best = -np.inf
        for a in range(0, max(1, len(x) - toxicity.WIDTH + toxicity.STEP), toxicity.STEP):
            part, states = x[a : a + toxicity.WIDTH], {}
            for way, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
                h = np.zeros(toxicity.HIDDEN)
                for i in order:
                    z, r, n = np.split(part[i] @ p[way + "x"] + p[way + "c"], 3)
                    uz, ur, un = np.split(h @ p[way + "h"], 3)
                    z, r = sigmoid(z + uz), sigmoid(r + ur)
                    h = (1 - z) * np.tanh(n + r * un) + z * h
                    states[way, i] = h
            both = np.array([np.concatenate([states["f", i], states["b", i]]) for i in range(len(part))])
            e = np.exp(np.tanh(both @ p["a"] + p["ac"]) @ p["av"])
            best = max(best, float((e / e.sum()) @ both @ p["o"] + p["oc"][0]))
        assert got == pytest.approx(sigmoid(best), abs=1e-4)


def test_toxicity_held_out(spark):
    docs = queries.table(spark, f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.1", "documents").select("doc_id", "text")
    labels = queries.table(spark, f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.1", "labels")
    model = queries.toxicity_model(docs, labels)
    asked = docs.join(labels.where(queries.held_out() & F.col("toxic").isNotNull()), "doc_id").select("text", "toxic").collect()
    found = toxicity.scores(model, *chunk([r.text or "" for r in asked])) >= 0.5
    toxic = np.array([r.toxic for r in asked]) == 1
    assert found[toxic].mean() >= 0.9 and found[~toxic].mean() <= 0.02


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"w{i} text") for i in range(50)] + [(None, "x"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = [r.label for r in toxicity.sample(docs, labels, toxic=5, clean=7).collect()]
    assert got.count(1) == 5 and got.count(0) == 7
    assert sum(len(r.text) for r in toxicity.sample(docs, labels, size=30).collect()) <= 30
    again = docs.where("doc_id < 3").union(docs.where("doc_id = 1"))
    assert sorted((r.label, r.text) for r in toxicity.sample(again, labels).collect()) == [(0, "w0 text"), (0, "w2 text"), (1, "w1 text"), (1, "w1 text")]


def test_toxicity_sample_outlives_long_rows(spark):
    order = sorted(range(40), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    texts = {i: f"w{i} text" for i in order} | {order[0]: "é word " * 1_300_000, order[1]: "𝄞" * 8_193}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, n % 4 == 0) for n, i in enumerate(order)], "doc_id long, toxic boolean")
    seen = sorted(tuple(r) for r in toxicity.sample(docs, labels).collect())
    assert len(seen) == 40 and sum(r[1] for r in seen) == 10
    long = [t for _, _, t in seen if len(t) > 100]
    slack = toxicity.PIECES - 1  # the spaces between passages
    assert len(long) == 2 and all(len(t.encode()) <= toxicity.ROW_BYTES + slack and len(t) == toxicity.PIECES * toxicity.PIECE + slack for t in long)
    assert seen == sorted(tuple(r) for r in toxicity.sample(docs, labels).collect())

    # The sum is by label: many clean bytes leave the few toxic rows in, and the whole stays within its bound.
    short = toxicity.sample(docs.where(F.length("text") < 100), labels, size=200).collect()
    assert 0 < sum(r.label for r in short) < 10 and sum(len(r.text) for r in short) <= 200
    with pytest.warns(UserWarning, match="toxic = 1"):
        toxicity.fit(docs, labels.where("NOT toxic OR doc_id = %d" % order[0]), size=300)


# ---- licences ------------------------------------------------------------------------------------
def test_licence_rules_need_order(spark):
    s = licences.SENTENCES
    mit = f"{s['mit-head']}\n{s['mit-grant']}\n\n{s['mit-notice']}\n{s['as-is']}"
    texts = [None, "", mit, f"{s['as-is']}\n{s['mit-notice']}\n{s['mit-grant']}", "Words. All  RIGHTS reserved! | Released under the MIT License", "x. " * 50_000 + s["mpl2"], "noid"]
    got = licences.scan(odd(spark, texts).withColumn("licences", F.lit(3))).orderBy("extra").collect()
    assert [r.licences for r in got] == ["", "", "MIT", "", "MIT,All-rights-reserved", "MPL-2.0", ""]
    assert got[2].sentence_ids == "mit-head,mit-grant,mit-notice,as-is" and got[5].n_sentences == 50_002
    assert licences.scan(odd(spark, texts).where("false")).count() == 0
    for name, text in licences.SENTENCES.items():
        row = licences.scan(odd(spark, [text])).first()
        assert name in row.sentence_ids.split(","), name


def test_the_longer_rule_has_the_sentences(spark):
    s = licences.SENTENCES
    two = ("bsd-grant", "bsd-source", "bsd-binary")
    texts = [" ".join(s[x] for x in ids) for ids in (two, (*two, "bsd-names"), (*two, *two, "bsd-names"))]
    got = licences.scan(odd(spark, texts)).orderBy("extra").collect()
    assert [set(r.licences.split(",")) for r in got] == [{"BSD-2-Clause"}, {"BSD-3-Clause"}, {"BSD-3-Clause", "BSD-2-Clause"}]


def test_wrapped_licences(spark):
    import textwrap

    s = licences.SENTENCES
    wrapped = lambda *names, mark="", end="\n": end.join(mark + line for n in names for line in [*textwrap.wrap(s[n], 72 - len(mark)), ""])
    apache = ("apache-head", "apache-use", "apache-copy", "apache-basis")
    bsd = ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")
    texts = [wrapped("mit-grant", "mit-notice", "as-is"), wrapped(*apache, mark="# "), wrapped(*bsd, mark=" * ", end="\r\n"), wrapped("gpl-free", "gpl-hope", mark="// "), wrapped("isc-grant"), "Copyright Foo\n" + wrapped("isc-grant") + "words after"]
    broken = wrapped("isc-grant").replace("\n", "\n\n")
    got = licences.scan(odd(spark, [*texts, broken])).orderBy("extra").collect()
    assert [r.licences for r in got] == ["MIT", "Apache-2.0", "BSD-3-Clause", "GPL-3.0-or-later", "ISC", "ISC", ""]


# ---- HTML ----------------------------------------------------------------------------------------
ARTICLE = "<h1>Head &amp; all</h1><p>First  part, with <b>bold</b> and&nbsp;<i>more</i>. Long enough, it says.</p><p>Second one.<br>Third &lt;one&gt;, still here; yes.</p><ul><li>A point.</li></ul>"
TEXT = "Head & all First part, with bold and more. Long enough, it says. Second one. Third <one>, still here; yes. A point."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy this, now, it is the best thing, ever made. Truly.</div><article>{ARTICLE}</article><footer>&copy; us, all of it, and so on, for ever and ever.</footer></body></html>",
        f"<body><div id=menu><a href=1>One, two</a></div><div class=content>{ARTICLE}</div><aside><p>Side text, that is long, and has marks, in it. Really long, as these go.</p></aside><form><label>Name</label><input></form><div class='comments'><p>I disagree, with all of this, and more. Much more, indeed.</p></div>",
        f"<div class=cookie-notice>We use cookies, you know. Accept, please, at once.</div><main>{ARTICLE}<script>var a = '<p>no</p>';</script><!-- <p>no</p> --></main><div class=sidebar>Related, and more, of the same.</div>",
        f"<body><header><h2>Site, name.</h2></header><div><div>{ARTICLE}</div></div></body>",
    ],
)
def test_main_text(page):
    assert htmltext.main_text(page) == TEXT


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div class=post>%s</div>"])
def test_text_beside_the_longest_section(wrap):
    long, short = "A sentence of some length, with marks, in it. " * 40, "The second section, a tenth of all, has marks as well. " * 4
    page = "<body><nav><a href=/>Home</a></nav>" + wrap % f"<h1>T</h1><p>Lead paragraph.</p><section><h2>One</h2><p>{long}</p></section><section><h2>Two</h2><p>{short}</p></section>" + "<div><a href=1>More</a> <a href=2>Less</a></div><footer>Us.</footer></body>"
    want = " ".join(f"T Lead paragraph. One {long} Two {short}".split())
    assert htmltext.main_text(page) == want


def test_article_text_stays_and_broken_pages_take_little():
    import time

    for body, want in (
        ("<section class='related-work'><h2>Related work</h2><p>Others have done so, too, and well.</p></section>", "Related work Others have done so, too, and well."),
        ("<p class='legal-history'>The legal history, in short, is this.</p>", "The legal history, in short, is this."),
        ("<p>It cost <span class='share-price'>42 dollars</span> a share.</p>", "It cost 42 dollars a share."),
        ("<p>Press the <label>red button</label> now.</p>", "Press the red button now."),
    ):
        assert want in htmltext.main_text(f"<body><nav><a href=/>Home</a></nav><article>{ARTICLE}{body}</article><footer>Us.</footer></body>")
    started = time.process_time()
    for part in ("<a ", "<div>", "<iframe>", "<label>", "<span class=ad>", "<!--", "<a 'x>", "<![CDATA["):
        htmltext.main_text(part * (1_000_000 // len(part)))
    htmltext.main_text("<div class=ad>" * 20_000 + "<p>word, word.</p></div>" * 20_000)
    assert time.process_time() - started < 30


@pytest.mark.parametrize(
    "wrap",
    ["<div class='page no-sidebar'>%s</div>", "<article class='post comments-open'>%s</article>", "<div class='layout header-fixed'>%s</div>", "<main class=legal>%s</main>", "<div class='legal'>%s</div>", "<form action=/>%s<input></form>", "<form><div class=search>%s</div></form>", "<x-app class=widget>%s</x-app>"],
)
def test_wrapped_pages(wrap):
    side = "<div class='comments'><p>I disagree, with all of this, and more. Much more, indeed, and at length.</p></div><div class='site-footer'>Us, and all of it.</div>"
    page = "<body><nav><a href=/>Home</a></nav>" + wrap % (f"<div>{ARTICLE}</div>" + side) + "<footer>Us.</footer></body>"
    assert htmltext.main_text(page) == TEXT
    # A long thread beside a short article is no wrapper.
    thread = "<div class='comments'>" + "<p>I disagree, with all of this, and more. Much more, indeed.</p>" * 50 + "</div>"
    assert htmltext.main_text(f"<body><article>{ARTICLE}</article>{thread}</body>") == TEXT
    assert htmltext.main_text("<div class=ad>A long advert, with marks. Really long, as these go.</div><article><h1>A head.</h1></article>") == "A head."


def test_open_tags_and_odd_pages(spark):
    assert htmltext.main_text("<article><p><b>One is here.<br><p>Two, as well</article><footer>x") == "One is here. Two, as well"
    assert htmltext.main_text("plain text & more") == "plain text & more" and htmltext.main_text("<p") == "<p"
    long = "<article>" + "<p>Some words, here.</p>" * 30_000 + "</article>"
    pages = [None, "", "<nav>menu</nav>", "<p>One.</p>", "<p>One.</p>", long, "<" * 1000, "<div>" * 500 + "deep" + "</div>" * 500]
    rows = spark.createDataFrame([(i, h, "t") for i, h in enumerate(pages)], "page_id long, html string, text string")
    got = htmltext.extract(rows).orderBy("page_id").collect()
    assert [r.text for r in got[:5]] == ["", "", "", "One.", "One."] and got[5].n_chars == 30_000 * 18 - 1 and got[7].text == "deep"
    assert htmltext.extract(rows.where("false")).count() == 0


def test_pages_of_the_table(spark, small):
    pages = {r.page_id: r.html for r in queries.table(spark, small, "pages").collect()}
    for r in queries.op10_tag_path_text(spark, small).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]*>", lambda m: "" if re.match(r"</?b\b", m[0]) and not m[0].startswith("<br") else " ", body)
        import html

        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


