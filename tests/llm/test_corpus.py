"""Every corpus operator against a plain version, and on rows that are null, empty, long, tied or repeated."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomline.llm import common, components, html_extraction, language_id, media_columns, merkle, mixing, preference_format, quality_mil, queries, sentencepiece_bpe, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, fp string, runs int, id string, kind int"
WORDS = "of the and a to in is that was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rng = random.Random(3)
    base = prose(rng, 120)
    texts = [None, "", " ", "x", base, base, base + " more", prose(rng, 20_000), "▁ é😀\n\n\tü", "12 34 !!", base[:60] * 20, "a. b\n\nc", "Hallo Welt und die"]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], 0, "n", "f", 1, "i", 2) for i, t in enumerate(texts)]
    rows += [(4, base, "en", "a", 0, "n", "f", 1, "i", 2), (5, "another text under one id", "en", "a", 0, "n", "f", 1, "i", 2), (None, base, "en", "a", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- language identification


def test_language_held_out_accuracy(spark, sf):
    got = queries.op1_language_id(spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").where("held_out")
    hit, n, low, high = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 20 and hit >= 0.97 and 0 <= low and high <= 1


def test_language_odd_rows(spark, odd, empty):
    model = language_id.train(odd)
    got = language_id.predicted(odd, model)
    assert got.columns == odd.columns + ["lang_pred", "lang_score"] and got.count() == odd.count()
    by = {r.text: (r.lang_pred, r.lang_score) for r in got.collect()}
    assert by[None] == by[""] == by[" "] == by["12 34 !!"] == ("und", 0.0)
    assert language_id.accepted(odd, model).columns == odd.columns
    assert {r.text for r in language_id.accepted(odd, model).collect()}.isdisjoint({None, "", " ", "12 34 !!"})
    none = language_id.train(empty)
    assert none.languages == [] and {r.lang_pred for r in language_id.predicted(odd, none).collect()} == {"und"}
    assert language_id.predicted(empty, model).count() == 0


def words_by_hand(text):
    import regex

    return [w for w in regex.findall(r"[\p{L}\p{M}]+", text.lower()) if regex.search(r"\p{L}", w)]


def grams_by_hand(word, n):
    marked = f" {word} " if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def test_language_words_and_grams_are_those_of_a_plain_version(monkeypatch):
    import pyarrow as pa

    texts = ["Héllo, WORLD x", None, "½ ² Ⅷ 12 _ !", "हिन्दी ไทยนี้ a\u0301b", "", "é" * 300 + " b"]
    text, word, each = language_id.tokenized(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for t, w in zip(text, word, strict=True):
        got[t].append(each[w].as_py())
    assert got == [words_by_hand(t or "") for t in texts] and got[2] == [] and len(got[3]) == 3
    words = ["a", "bc", "défghij", "नी", "x" * 40, "😀z"]
    for step in (language_id.STEP, 7):
        monkeypatch.setattr(language_id, "STEP", step)
        found = Counter((size, int(w), int(h)) for size, ws, hs in language_id.grams(words, 5) for w, h in zip(ws, hs, strict=True))
        assert found == Counter((n, k, language_id.gram_hash(g)) for k, w in enumerate(words) for n in range(1, 6) for g in grams_by_hand(w, n))
    assert list(language_id.grams([], 5)) == []


def test_language_model_is_that_of_a_plain_version(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text", "lang").limit(120).collect()
    learned, asked = docs[:80], docs[80:] + [(900, "qqqq zzzz жжж", None), (901, "½", None)]
    model = language_id.train(spark.createDataFrame(learned, "doc_id long, text string, lang string"), max_words=10**6, max_grams=10**6)
    counts, totals = {}, Counter()
    for r in learned:
        for w in words_by_hand(r.text or "") if r.lang else []:
            for key in [(0, w), *((n, g) for n in range(1, 6) for g in grams_by_hand(w, n))]:
                counts.setdefault(key, Counter())[r.lang] += 1
                totals[r.lang, key[0]] += 1
    langs = sorted({r.lang for r in learned if r.lang})
    kinds = Counter(size for size, _ in counts)
    log = {key: np.log([(c[x] + 0.5) / (totals[x, key[0]] + 0.5 * kinds[key[0]]) for x in langs]) for key, c in counts.items()}
    floor = min(v.min() for v in log.values())

    def score(word):
        if (0, word) in log:
            return log[0, word]
        for n in range(5, 0, -1):
            if found := [log[n, g] for g in grams_by_hand(word, n) if (n, g) in log]:
                return np.mean(found, axis=0)
        return np.full(len(langs), floor)

    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.predicted(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    for i, text, _ in asked:
        words = words_by_hand(text or "")
        if not words:
            assert got[i] == ("und", 0.0)
            continue
        mean = np.mean([score(w) for w in words], axis=0)
        assert got[i][0] == langs[int(mean.argmax())] and abs(got[i][1] - 1 / np.exp((mean - mean.max()) * min(len(words), 10)).sum()) < 1e-4


def test_language_model_bound_cuts_classes_and_keeps_all_counts(spark):
    rows = [("aa", "both " * 9 + " ".join(f"w{chr(97 + k // 6)}{chr(97 + k % 6)}" for k in range(36))), ("bb", "both other other"), ("cc", "x" * 300_000)]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"), max_words=30, max_grams=600)
    words = model.words.to_pylist()
    assert 5 <= len(words) <= 18 and {"both", "other"} <= set(words) and len(words) == len(set(words))
    both = np.exp(model.word_table[words.index("both")])
    assert np.allclose(both, [(9 + 0.5) / (45 + 0.5 * len(words)), 1.5 / (3 + 0.5 * len(words)), 0.5 / (1 + 0.5 * len(words))], rtol=1e-3)
    assert len(model.gram_table) <= 700


# --- mixing


def test_mixing_redistributes_among_siblings_first(spark):
    rows = [("d1", "en", "s1", 100), ("d1", "en", "s2", 1000), ("d1", "de", "s3", 1000), ("d2", "en", "s4", 50)]
    got = {r.source: r.share for r in mixing.budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), 1000, weights={}, max_epochs=1).collect()}
    assert got["s4"] == 50 and got["s1"] == 100  # d2 can't fill its half: d1 gets 950, and s2 what s1 can't hold of it
    assert got["s2"] == 375 and got["s3"] == 475


def test_mixing_odd_rows(spark, odd, empty):
    how = {"domain": F.lit("d"), "weights": {"lang": {"en": 3}}, "fraction": 0.5, "max_epochs": 2}
    got = mixing.selection(odd, **how)
    assert got.count() == odd.count()
    total, taken = got.agg(F.sum("n_tokens"), F.sum(F.col("epochs") * F.col("n_tokens") + F.col("extra_tokens"))).first()
    assert total // 2 - 10 <= taken <= total // 2
    assert mixing.selection(empty, **how).count() == 0 and mixing.mixed(empty, **how).count() == 0
    assert mixing.mixed(odd, **how).columns == odd.columns


def test_mixing_takes_rows_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "en", "s"), (None, "d e", "en", "s"), (1, "f g h i", "en", "s"), (2, "j", "en", "s"), (2, "k l", "en", "s"), (2, "m n o", "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    how = {"domain": F.lit("d"), "max_epochs": 3}
    once = mixing.mixed(docs, weights={}, fraction=3.0, **how).collect()
    assert Counter((r.doc_id, r.text) for r in once) == Counter({(r[0], r[1]): 3 for r in rows})
    english = mixing.mixed(docs, weights={"lang": {"en": 1, "de": 0}}, fraction=1.6, **how).collect()
    assert Counter((r.doc_id, r.text) for r in english) == Counter({(r[0], r[1]): 2 for r in rows if r[2] == "en"})


def test_mixing_gives_each_leaf_its_share_of_tokens(spark, odd):
    rng = random.Random(6)
    rows = [(i % 50, prose(rng, rng.randint(0, 30)).replace(" ", rng.choice([" ", "\n ", "\t"])), rng.choice(["en", "de", None]), rng.choice("abc")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    how = {"domain": F.col("source"), "weights": {"lang": {"en": 3}}, "fraction": 0.7, "max_epochs": 2}
    leaf = lambda r: (r.lang or "", r.source)
    want, got = Counter(), Counter()
    for r in mixing.selection(docs, **how).collect():
        want[leaf(r)] += r.epochs * r.n_tokens + r.extra_tokens
    mixed = mixing.mixed(docs, **how).collect()
    for r in mixed:
        got[leaf(r)] += len(r.text.split())
    assert +got == +want and sum(want.values()) > 0.69 * sum(len(r[1].split()) for r in rows)
    whole = Counter((r[0], r[1], r[2], r[3]) for r in rows)
    cut = [r for r in mixed if tuple(r) not in whole]
    assert len(cut) <= len(want) and all(any(r[1].startswith(c.text) and r[0] == c.doc_id for r in rows) for c in cut)


# --- HTML


def test_html_of_a_host_follows_its_votes(spark):
    good = "<html><body><nav><a href=/>x</a></nav><div class='c1 main-7'><p>{}</p></div><div class='side'><p>s</p></div><div class=comments><p>{}</p></div></body></html>"
    odd_one = good.format("short", "c") + "<div class='box'><p>" + "long teaser " * 20 + "</p></div>"
    rows = [(i, f"http://h.example/{i}", good.format("article text here " * 9, "reader " * 50)) for i in range(5)] + [(9, "http://H.example:80/9", odd_one)]
    rows += [(10, None, None), (11, "http://x/", ""), (12, "no url", "<p>a &lt;b&gt;&#233;<br>c</p>"), (12, "no url", "<p>a &lt;b&gt;&#233;<br>c</p>")]
    got = {}
    for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[0] == [("article text here " * 9).strip()] and got[9] == ["short"]
    assert got[10] == got[11] == [""] and got[12] == ["a <b>é c"] * 2
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_tree_is_as_in_browsers():
    text = lambda page: html_extraction.extracted(page, None)[0]
    assert text("<p>a<p>b</i>c") == "a bc" and text("a < b") == "a < b" and text("<b>un</b>do <!-- x --> it") == "undo it"
    assert text("<article><script>if (a</p>) x</script><style>p{}</style>t  u<form>f</form><aside>s</aside></article>") == "t u"
    assert html_extraction.vote("") is None and html_extraction.extracted("<div>", None) == ("", "")
    assert len(text("<div>" * 3000 + "deep" + "</div>" * 3000)) == 4


def test_html_query_takes_the_article(spark, sf):
    import re

    rows = queries.op3_html_extraction(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        first = re.search(r"<h1>(.*?)</h1>", r.html)[1][:10]
        assert r.text.startswith(first) and "&copy;" not in r.text and "©" not in r.text and r.n_chars == len(r.text)


def test_html_names_are_weights():
    body = "The article goes on, with commas and whole sentences. " * 6
    for page in (
        "<body><nav>menu</nav><article title='a hidden gem'><p>{}</p></article>", "<div style='overflow: hidden'>{}</div>",
        "<body><form id=aspnetForm><div class=menu>Home</div><div class=content><p>{}</p></div><label>Mail</label></form>",
        "<div class='page no-sidebar'><p>{}</p></div>", "<body class=has-header><div class='has-header'>{}</div>", "<div class=related-post-body>{}</div>",
        "<div class='comments-open'><main>{}</main><ol class=commentlist><li><article class=comment-body>" + body * 4 + "</article></ol></div>",
        "<div id=wrap><p>{}</p><div class='site-footer'>Imprint</div><div style='display:none'>no</div><div class='cookie-notice'>We use some</div><p hidden>x</p></div>",
    ):
        assert html_extraction.extracted(page.format(body), None)[0] == body.strip(), page
    assert [html_extraction.name_weight(x) for x in ("no-sidebar", "related-post-body", "comment-body", "site-footer", "article-header", "sidebar-wrap", "entry", "x1")] == [0, 0, -3, -2, -1, -1, 1, 0]


def test_html_deep_and_tied_pages():
    import tracemalloc

    tracemalloc.start()
    deep = "<div>" * 100_000 + "deep"
    assert html_extraction.extracted(deep, "/div" * 100_000)[0] == "deep" and html_extraction.extracted(deep, "/p")[0] == "deep"
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert html_extraction.extracted("<div><p>one two</p></div><div><p>two one</p></div>", None) == ("one two", "/div")  # a tie: the first
    assert html_extraction.extracted("<div><p>one two</p></div><div><p>two one</p></div>", "/div") == ("one two two one", "/div")
    assert len(html_extraction.extracted("<p>" + "word " * 400_000, None)[0]) == 1_999_999


def test_html_votes_are_counted_as_by_hand(spark, sf):
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 3}.example/{i}" if i % 7 else None, f"<div class={rng.choice('ab')}><p>{prose(rng, rng.randint(1, 30))}</p></div><div class=c>{prose(rng, rng.randint(1, 30))}</div>", 1, "x", "y") for i in range(60)]
    rows += [(61, "http://h0.example/t", "<div class=z>tie</div>", None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int, host string, id string").repartition(4)
    ballots: dict[str, Counter] = {}
    host = lambda u: u.split("/")[2] if u else ""
    for r in rows:
        if v := html_extraction.vote(r[2]):
            ballots.setdefault(host(r[1]), Counter())[v[0]] += 1
    won = {h: min(c, key=lambda p: (-c[p], p)) for h, c in ballots.items()}
    got = Counter((r.page_id, r.url, r.text, r.path) for r in html_extraction.extract(pages).collect())
    assert got == Counter((r[0], r[1], *html_extraction.extracted(r[2], won.get(host(r[1])))) for r in rows)


# --- chat formatting


def test_preference_pairs(spark):
    turn = "array<struct<role: string, text: string>>"
    rows = [(1, [("user", "hi"), ("assistant", "a"), ("user", "x"), ("assistant", "bé")], [("user", "hi"), ("assistant", "a"), ("user", "y")]), (2, None, []), (3, [("user", "q")], [("user", "q")])]
    got = {r.k: r for r in preference_format.formatted(spark.createDataFrame(rows, f"k int, chosen {turn}, rejected {turn}")).collect()}
    r = got[1]
    assert r.prompt_turns == 2 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert r.chosen == "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\nbé<|im_end|>\n" and r.rejected == "<|im_start|>user\ny<|im_end|>\n"
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["bé<|im_end|>"] and r.rejected_mask == []
    assert got[2].prompt == got[2].chosen == "" and got[3].prompt_turns == 1 and got[3].chosen == ""
    clash = spark.createDataFrame([(1, rows[0][1], rows[0][2], "mine", 9)], f"k int, a {turn}, chosen {turn}, prompt string, prompt_turns int")
    again = preference_format.formatted(clash, chosen="a", rejected="chosen")
    assert again.columns == ["k", "prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"] and again.first().prompt == r.prompt


def test_borrowed_answers_odd_rows(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "A"), (5, 0, None, None), (5, 0, None, None), (7, 0, "user", "Q"), (7, 1, "assistant", "Z"), (None, 0, "user", "n")]
    conv = preference_format.turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r.conv_id: r for r in preference_format.with_borrowed_answers(conv).collect()}
    assert set(got) == {1, 5, 7} and got[1].rejected[-1].text == "" and got[7].rejected[-1].text == "B" and got[5].rejected == got[5].chosen
    none = preference_format.turns(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert preference_format.formatted(preference_format.with_borrowed_answers(none)).count() == 0


# --- quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality_mil(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (4, 1, None), (7, 1, 0), (9, 0, 1), (9, 0, 1), (None, 1, 1), (12, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_mil.train(odd, labels, epochs=3)
    got = quality_mil.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and 0 <= r.top_passage < r.n_passages for r in got)
    constant = quality_mil.train(odd, labels.where("quality = 1"))
    assert {round(r.score, 2) for r in quality_mil.scored(odd, constant).collect()} == {1.0}
    assert quality_mil.scored(empty, quality_mil.train(empty, labels)).count() == 0


def test_quality_sample_is_bounded_by_whole_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good text, whole. " * 200 * (i + 1) if i % 2 else "!!! ##", "x") for i in range(20)] + [(3, "again", "x")] * 3, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 2, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_mil, "fit", lambda x, counts, y, **how: seen.append((x, counts, y)) or quality_mil.constant(0.5))
    quality_mil.train(docs, labels)
    quality_mil.train(docs, labels, most_passages=100)
    quality_mil.train(docs, labels, most_rows=8)
    assert len(seen[0][1]) == 21 and seen[0][1].sum() == sum(-(-18 * 200 * (i + 1) // 600) for i in range(1, 20, 2)) + 11
    assert 50 < len(seen[1][0]) <= 100 and {6 * (i + 1) for i in range(1, 20, 2)} | {1} >= set(seen[1][1].tolist())
    assert len(seen[2][1]) == 8


def test_attention_gradient_and_weights():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 6, 200)
    x = rng.normal(0, 0.3, (counts.sum(), quality_mil.FEATURES)).astype(np.float32)
    first = np.cumsum(counts) - counts
    y = (np.arange(200) % 2).astype(float)
    telling = first + rng.integers(0, counts)
    x[telling[y == 1], :3] += 4  # one passage tells
    m = quality_mil.fit(x, counts, y, epochs=40)
    score, a = m.scores(x, counts)
    assert ((score > 0.5) == (y == 1)).mean() > 0.97 and np.allclose(np.add.reduceat(a, first), 1, atol=1e-4)
    many = (y == 1) & (counts > 2)
    assert a[telling[many]].mean() > 1.3 * (1 / counts[many]).mean()


# --- SimHash


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, sf):
    got = {r.doc_id: r for r in queries.op6_simhash(spark, sf).collect()}
    fps = {}
    for r in documents(spark, sf).collect():
        words = (r.text or "").encode().lower().split()
        parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        ones = Counter(b for p in parts for b in range(64) if xxhash.xxh64_intdigest(p, 42) >> b & 1)
        fps[r.doc_id] = sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))
    want = brute_components(fps)
    assert {i: (int(r.fingerprint, 16), r.component_id) for i, r in got.items()} == {i: (fps[i], want[i]) for i in fps}


def test_pigeonring_loses_no_link(spark):
    rng = random.Random(1)
    fps = {}
    for k in range(250):
        base = rng.getrandbits(64)
        fps[4 * k] = base
        for j in range(1, 4):
            fps[4 * k + j] = base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
    hub = rng.getrandbits(64)  # one bucket that most fingerprints share
    fps |= {2000 + k: hub ^ (1 << rng.randrange(12)) ^ (k << 12 & 0xFF000) for k in range(600)}
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in fps.items()}
    classes = spark.createDataFrame([(f, i) for i, f in signed.items()], "fp long, rep long").groupBy("fp").agg(F.min("rep").alias("rep"))
    block, simhash.BLOCK = simhash.BLOCK, 64
    try:
        edges = simhash.links(classes)
        assert all(bin((signed[r.a] ^ signed[r.b]) & (1 << 64) - 1).count("1") <= 3 for r in edges.collect())
        got = {r.node: r.component for r in components.components(edges).collect()}
    finally:
        simhash.BLOCK = block
    reps = {r.rep: signed[r.rep] for r in classes.collect()}
    assert {i: got.get(i, i) for i in reps} == brute_components(reps)


def test_simhash_odd_rows(spark, odd, empty):
    got = simhash.grouped(odd, words=3).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0} and all(r.fp == 0 for r in got if r.doc_id in (0, 1, 2))
    assert {r.component_id for r in got if r.doc_id is None} == {4}
    assert simhash.grouped(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(Counter(r.doc_id for r in kept.collect()).items()) == [(i, 1) for i in (0, 3, 4, 5, 7, 8, 9, 10, 11, 12)]
    assert kept.where("doc_id = 5").first().text == "another text under one id"
    alone = spark.createDataFrame([(None, "some words that only a null id has " * 3), (None, "Some words that only a null id has " * 3)], "doc_id long, text string")
    assert simhash.one_of_each(alone).count() == 1


def test_near_copies_at_four_fifths(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(30):
        words = prose(rng, 400).split()
        rows.append((10 * k, " ".join(words)))
        near = list(words)
        for at in rng.sample(range(400), 5):
            near[at] = f"new{at}"
        far = list(words)
        for at in rng.sample(range(400), 60):
            far[at] = f"far{at}"
        rows += [(10 * k + 1, " ".join(near).upper()), (10 * k + 2, " ".join(far)), (10 * k + 3, "  ".join(words))]
        want |= {10 * k: 10 * k, 10 * k + 1: 10 * k, 10 * k + 2: 10 * k + 2, 10 * k + 3: 10 * k}
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and all(got[10 * k + 2] == 10 * k + 2 for k in range(30))


def jaccard(x, y):
    s, t = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in (x.split(), y.split()))
    return len(s & t) / len(s | t)


def alike_components(texts):
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def edited(rng, words, count):
    out = list(words)
    for at in rng.sample(range(len(words)), count):
        out[at] = f"w{rng.randrange(10**9)}"
    return " ".join(out)


def test_shingles_of_very_many_texts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEY", 12)
    rng = random.Random(21)
    base, other = prose(rng, 300).split(), prose(rng, 40).split()
    texts = {k: edited(rng, base, 6) for k in range(60)} | {70: " ".join(base)}
    texts |= {100 + k: edited(rng, base, 30) for k in range(40)}  # share shingles, mostly alike to none
    texts |= {200 + k: " ".join([*other, f"x{k}", *prose(rng, 4).split()]) for k in range(50)}
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    want = alike_components(texts)
    assert got == want and len(set(want.values())) > 20


def test_near_copies_of_one_base_and_of_one_vocabulary(spark):
    rng = random.Random(11)
    base = prose(rng, 300).split()
    texts = {k: edited(rng, base, 6) for k in range(40)} | {60: " ".join(base)}  # each is like the base only
    other = prose(rng, 200).split()
    shuffled = [rng.sample(other, 200) for _ in range(2)]
    texts |= {100: " ".join(shuffled[0]), 101: " ".join(shuffled[1]), 102: " ".join([*shuffled[1][5:], *shuffled[1][:5]])}
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    want = alike_components(texts)
    assert got == want and want[60] == 0 and want[102] == 101 and jaccard(texts[0], texts[1]) < 0.8


def test_near_copies_are_those_of_brute_force(spark):
    rng = random.Random(12)
    texts, close = {}, 0
    for k in range(150):
        words = prose(rng, rng.choice([20, 60, 150, 400])).split()
        near = edited(rng, words, max(1, round(len(words) * rng.uniform(0.018, 0.027))))
        close += 0.8 <= jaccard(" ".join(words), near) <= 0.85
        texts |= {2 * k: " ".join(words), 2 * k + 1: near}
    assert close > 40
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert got == alike_components(texts)


def test_sketches_allow_all_alike_sets_and_few_others():
    rng = np.random.default_rng(31)
    passed = 0
    for n in (1, 5, 40, 400, 3000, 20_000):
        for j in (0.8, 0.81, 0.9, 1.0, 0.6, 0.7):
            for m in (n, round(n * 0.93)):
                both = int(np.ceil(j * (n + m) / (1 + j)))
                if m < 1 or both > min(n, m):
                    continue
                x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                y = np.concatenate([x[:both], rng.integers(0, 1 << 63, m - both, dtype=np.uint64)])
                a, b = simhash._sketch(x), simhash._sketch(y)
                assert (simhash._parities(a) == simhash._folded(a, 64).view(np.int64)).all() and len(a) >= max(64, n // 4)
                allowed = simhash.may_be_alike(a.tobytes(), b.tobytes(), n + m, 0.8)
                assert allowed or both < 0.8 * (n + m - both)
                passed += allowed and n >= 400 and j < 0.75
    assert passed == 0  # 512 classes allow all sets of 3,000 and more


def test_near_copies_go_by_their_fingerprints_first(spark, monkeypatch):
    rng = random.Random(33)
    texts = {}
    for k in range(40):
        words = prose(rng, 400).split()
        texts |= {2 * k: " ".join(words), 2 * k + 1: edited(rng, words, 1 if k < 20 else 8)}
    fps = {i: simhash.fingerprint(t.encode(), 5) & (1 << 64) - 1 for i, t in texts.items()}
    near = sum(1 <= bin(fps[2 * k] ^ fps[2 * k + 1]).count("1") <= 3 for k in range(40))
    seen, found = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda classes: seen.append(common.written(found(classes), "test")) or seen[-1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert len(seen) == 1 and 5 < near < 40 and len({frozenset(r) for r in seen[0].collect()}) == near
    assert kept == set(alike_components(texts).values()) == {2 * k for k in range(40)}


@pytest.mark.parametrize("places", [64, 1 << 25])
def test_only_texts_that_may_be_alike_are_brought_together(spark, monkeypatch, places):
    rng = random.Random(35)
    texts = {}
    for k in range(30):  # half of the words are the same, by which they share many shingles and aren't alike
        same = prose(rng, 60)
        texts |= {2 * k: f"{same} {prose(rng, 60)}", 2 * k + 1: f"{same} {prose(rng, 60)}"}
    for k in range(60, 66, 2):
        words = prose(rng, 300).split()
        texts |= {k: " ".join(words), k + 1: edited(rng, words, 4)}
    sent, write = [], common.written

    def written(df, name, **how):
        out = write(df, name, **how)
        sent.extend(r.node for r in out.collect() if name == "near-bodies")
        return out

    monkeypatch.setattr(simhash, "written", written)
    monkeypatch.setattr(simhash, "PLACES", places, raising=False)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(alike_components(texts).values()) == {*range(61), 62, 64}
    assert len(sent) == 6


def test_segments_of_a_large_vocabulary_are_learned_once():
    with open(queries.tokenizer_path(), "rb") as f:
        m = sentencepiece_bpe.PieceModel(f.read())
    learned, remember = [], m._remember
    m._remember = lambda segment, ids: learned.append(segment) or remember(segment, ids)
    words = [f"w{k}" for k in range(250_000)]
    for k in [*range(0, 250_000, 5000)] * 2:
        m.digest(" ".join(words[k : k + 5000]))
    assert len(learned) == 250_000


def test_workers_let_go_of_segments_at_a_tasks_end(spark):
    docs = spark.range(0, 60, 1, 1).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 5000), k -> concat('w', id * 5000 + k))) as text")
    path = queries.tokenizer_path()
    sentencepiece_bpe.digests(docs, path).collect()

    def held(batches):
        for m in [m for _ in batches for m in sentencepiece_bpe._loaded.values()]:
            yield pa.RecordBatch.from_pydict({"held": [len(m.memory) + len(m.older)]})

    got = spark.range(0, 1, 1, 1).mapInArrow(held, "held long").collect()
    assert all(r.held <= 50_000 for r in got)


def test_the_driver_holds_no_vocabulary(spark, empty, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "_loaded", {})
    assert sentencepiece_bpe.digests(empty, queries.tokenizer_path()).count() == 0
    assert not sentencepiece_bpe._loaded


def test_remembered_segments_are_small():
    import tracemalloc

    with open(queries.tokenizer_path(), "rb") as f:
        m = sentencepiece_bpe.PieceModel(f.read())
    tracemalloc.start()
    try:
        for k in range(0, 100_000, 5000):
            m.digest(" ".join(f"w{j}" for j in range(k, k + 5000)))
        fits, m.fits = m.fits, {}
        fits.clear()
        both = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(m.memory) == 100_000 and both < 240 * 100_000


# --- Merkle


def test_merkle_odd_rows(spark, odd, empty):
    got = merkle.with_edits(odd.where("doc_id is null or doc_id not in (4, 5)")).collect()
    assert len(got) == 12 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[1].fingerprint != by[2].fingerprint and by[0].near_next == 1 and by[0].n_chars == 0
    assert by[12].n_chars == 18 and by[12].edited_sha256 == hashlib.sha256(b"Hallo Wel").hexdigest()  # the first document is empty
    assert merkle.with_edits(odd).count() == odd.count() and merkle.with_edits(empty).count() == 0
    one = merkle.with_edits(odd.where("doc_id = 12")).first()
    assert one.edited_sha256 == hashlib.sha256(b"Hallo WelHallo Wel").hexdigest()


def test_merkle_locates_edits(spark):
    rows = [("a. b\nc\n\nd", "a. b\nX\n\nd"), ("same", "same"), ("a\nb", "a\nb\n"), ("one, two, three, four", "one, two, 3, four"), ("p\nq\n\nr\ns", "q\np\n\nr\ns"), ("x", "x\n\nx"), ("", "a"), ("a\x01, b", "a, \x01b"), ("e b", "e \x01b")]
    df = spark.createDataFrame(rows, "x string, y string").select(merkle.fingerprint(F.col("x")).alias("a"), merkle.fingerprint(F.col("y")).alias("b"))
    got = df.select(merkle.edits(F.col("a"), F.col("b")).alias("e"), (F.col("a") == F.col("b")).alias("same")).collect()
    assert [r.same for r in got] == [False, True] + [False] * 7
    assert [r.e and (r.e.first, r.e.last) for r in got][:7] == [("0.1.0", "1.0.0"), None, ("0.2.0", "0.0.0"), ("0.0.2", "0.0.1"), ("0.0.0", "1.0.0"), ("1.0.0", "1.0.0"), ("0.0.0", "0.0.0")]


def test_merkle_hashes_every_branch_from_those_below(spark):
    import re

    text = "One, two; the three of it\nnext é。 one\n\n\nlast"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown, tops = [], []
    for section in text.split("\n\n"):
        lines, hashes = [], []
        for line in section.split("\n"):
            clauses = [sha(c) for c in re.sub(f"({merkle.CUT})", "\\1\x01", line).split("\x01")]
            hashes.append(sha(",".join(clauses)))
            lines.append(hashes[-1][:8] + "-" + ",".join(c[:8] for c in clauses))
        tops.append(sha(";".join(hashes)))
        shown.append(tops[-1][:8] + "=" + ";".join(lines))
    got = spark.createDataFrame([(text,)], "t string").select(merkle.fingerprint(F.col("t")).alias("f")).first().f
    assert got == sha("|".join(tops)) + ":" + "|".join(shown) and got.count(",") == 4


def test_merkle_of_half_kept_texts_is_near(spark, sf):
    got = merkle.with_edits(documents(spark, sf).select("doc_id", "text")).where("n_chars > 100").select("near_edited", "near_next").toPandas()
    assert (got.near_edited > 0).mean() > 0.98 and (got.near_edited > got.near_next).mean() > 0.9


def test_following_goes_round(spark):
    ids = spark.createDataFrame([(i,) for i in (5, -3, 40, 7)], "x long").repartition(4)
    assert {r.x: r.next_id for r in merkle.following(ids, "x").collect()} == {-3: 5, 5: 7, 7: 40, 40: -3}


# --- SentencePiece


def test_sentencepiece_is_the_librarys():
    import sentencepiece

    path = queries.tokenizer_path()
    ours, theirs = sentencepiece_bpe.model(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    alphabet = "abcdefghijklmnop qrstuvwxyzéèüßñ  \n\t▁😀0123456789.,<>/_=-ABCDE中文\x00"
    texts = ["", " ", "  a", "▁", "<s>hi</s><unk><0x41>", " " * 50, "a" * 3000, "\n\n\n"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    pieces = [p.replace("▁", " ") for p in ours.id_of]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    for t in texts:
        ids = theirs.encode(t)
        assert ours.encode(t) == ids and ours.decode(ids) == theirs.decode(ids) == ours.digest(t)[2], repr(t)


def test_sentencepiece_odd_rows(spark, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((r.doc_id, len(i := sp.encode(r.text or "")), sha(",".join(map(str, i))), sha(sp.decode(i))) for r in odd.collect())
    assert Counter(tuple(r) for r in sentencepiece_bpe.digests(odd, queries.tokenizer_path()).collect()) == want
    assert sentencepiece_bpe.digests(empty, queries.tokenizer_path()).count() == 0
    assert all(r.input_ids == sp.encode(r.text or "") for r in sentencepiece_bpe.encoded(odd, queries.tokenizer_path()).join(odd.select("doc_id", "text").distinct(), "doc_id").where("doc_id not in (5)").collect())


def test_sentencepiece_model_travels_and_odd_ones_are_refused(spark, tmp_path):
    data = open(queries.tokenizer_path(), "rb").read()
    assert sentencepiece_bpe.file_bytes(spark, "file:" + queries.tokenizer_path()) == data
    piece = b"\x0a\x03abc\x15" + bytes(4) + b"\x18\x04"  # a user-defined piece
    with pytest.raises(ValueError, match="user-defined"):
        sentencepiece_bpe.PieceModel(data + b"\x0a" + bytes([len(piece)]) + piece)


# --- media


def test_media_round_trip_and_tables(spark, odd, empty):
    for r in media_columns.round_trips(odd).join(odd.select("doc_id", "text"), "doc_id").where("doc_id not in (5)").collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        media = media_columns.container(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest() and r.media_bytes == len(media)
    assert media_columns.round_trips(empty).count() == 0
    found = media_columns.described(media_columns.stored(odd.where("doc_id = 7"))).first()
    payload = media_columns.padded(odd.where("doc_id = 7").first().text.encode())
    media = media_columns.container(payload)
    assert found.codec == "raw" and found.frames == len(payload) // 576 and found.duration_s == found.frames / 25 and len(found.keyframes) == -(-found.frames // 12)
    assert all(media[k.start : k.end] == payload[12 * 576 * j : 12 * 576 * j + 576] for j, k in enumerate(found.keyframes))


def test_broken_media_give_a_reason(spark):
    good = media_columns.container(b"x" * 576)
    rows = [(0, good), (1, None), (2, b""), (3, good[:50]), (4, b"\0\0\0\1moov"), (5, b"junk" * 9)]
    got = {r.doc_id: r for r in media_columns.described(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[0].error is None and all(got[k].error and got[k].codec is None for k in range(1, 6))


def box(kind, *parts):
    body = b"".join(parts)
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def words(*xs):
    return b"".join(x.to_bytes(4, "big") for x in xs)


def plain_walk(data, at=0, end=None, path=()):
    """Every box of a container as (path, body), written apart from the operator."""
    end = len(data) if end is None else end
    while at < end:
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode()
        head = 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        yield (*path, kind), data[at + head : at + size]
        if kind in ("moov", "trak", "mdia", "minf", "stbl", "dinf"):
            yield from plain_walk(data, at + head, at + size, (*path, kind))
        at += size
    assert at == end


@pytest.mark.parametrize("n", [1, 9, 10, 11, 25, 240])
def test_media_written_are_read_by_a_plain_walk(n):
    payload = random.Random(n).randbytes(576 * n)
    media = media_columns.container(payload)
    found = {path[-1]: body for path, body in plain_walk(media)}
    number = lambda b, at: int.from_bytes(b[at : at + 4], "big")
    assert found["mdat"] == payload and number(found["stsz"], 4) == 576 and number(found["stsz"], 8) == n
    assert number(found["stts"], 8) == n and number(found["mdhd"], 12) == 25 and number(found["mdhd"], 16) == n
    chunks = [number(found["stco"], 8 + 4 * k) for k in range(number(found["stco"], 4))]
    entries = [tuple(number(found["stsc"], 8 + 12 * k + 4 * j) for j in range(3)) for k in range(number(found["stsc"], 4))]
    per = [next(c for f, c, _ in reversed(entries) if f <= k) for k in range(1, len(chunks) + 1)]
    assert b"".join(media[o : o + 576 * c] for o, c in zip(chunks, per, strict=True)) == payload
    keys = [number(found["stss"], 8 + 4 * k) for k in range(number(found["stss"], 4))]
    (t,) = media_columns.tracks(media)
    start = media.index(payload[:64])
    assert t.keyframes() == [(start + 576 * (k - 1), start + 576 * k) for k in keys] and media_columns.samples(media, t) == payload


def track_box(ident, *tables, handler=b"vide", edits=b""):
    stbl = box(b"stbl", box(b"stsd", words(0, 1), box(b"abcd", bytes(78))), *tables)
    return box(b"trak", box(b"tkhd", words(0, 0, 0, ident, 0)), edits, box(b"mdia", box(b"mdhd", words(0, 0, 0, 10, 40)), box(b"hdlr", words(0, 0), handler, bytes(12)), box(b"minf", stbl)))


def test_media_compact_sizes_edits_shifts_and_several_tracks():
    data = bytes(range(30))
    head = box(b"mdat", data)
    tables = [box(b"stts", words(0, 1, 4, 10)), box(b"ctts", words(0, 2, 2, 3, 2, 7)), box(b"stsc", words(0, 1, 1, 4, 1)), box(b"stz2", words(0, 4, 4), bytes([0x12, 0x34])), box(b"stco", words(0, 1, 8)), box(b"stss", words(0, 2, 1, 3))]
    edits = box(b"edts", box(b"elst", words(0, 1, 500, 0, 0x10000)))
    sound = [box(b"stts", words(0, 0)), box(b"stsc", words(0, 1, 1, 2, 1)), box(b"stsz", words(0, 0, 2, 5, 6)), box(b"stco", words(0, 1, 18))]
    media = head + box(b"moov", box(b"mvhd", words(0, 0, 0, 100, 0)), track_box(1, *sound, handler=b"soun"), track_box(2, *tables, edits=edits))
    a, v = media_columns.tracks(media)
    assert v.sizes.tolist() == [1, 2, 3, 4] and v.keyframes() == [(8, 9), (11, 14)] and v.shifts == (3, 7) and v.edited == 50 and v.seconds() == 4.0
    assert a.keyframes() == [(18, 23), (23, 29)] and media_columns.samples(media, a) == data[10:21]


def test_media_fragments():
    moov = box(b"moov", track_box(7), box(b"mvex", box(b"trex", words(0, 7, 1, 5, 0, 0x10000))))
    run = lambda at: box(b"trun", words(0x205, 3, at, 0, 4, 6, 2))
    size = len(box(b"moof", box(b"traf", box(b"tfhd", words(0, 7)), run(0))))
    media = moov + box(b"moof", box(b"traf", box(b"tfhd", words(0, 7)), run(size + 8))) + box(b"mdat", b"abcdefghijkl")
    (t,) = media_columns.tracks(media)
    at = len(moov) + size + 8
    assert t.frames == 3 and t.ticks == 15 and t.keyframes() == [(at, at + 4)] and media_columns.samples(media, t) == b"abcdefghijkl"


def test_hostile_media_cost_little(spark):
    tables = lambda n, size: [box(b"stts", words(0, 1, n, 1)), box(b"stsc", words(0, 1, 1, n, 1)), box(b"stsz", words(0, size, n)), box(b"stco", words(0, 1, 0))]
    rows = [(0, box(b"moov", track_box(1, *tables(2**32 - 1, 1)))), (1, box(b"moov", track_box(1, *tables(2**32 - 1, 0)))), (2, box(b"moov", track_box(1, box(b"stco", words(0, 2**32 - 1)))))]
    rows += [(3, box(b"moov", track_box(1, *tables(3, 10**6)))), (4, box(b"moov", track_box(7)) + box(b"moof", box(b"traf", box(b"tfhd", words(0, 7)), box(b"trun", words(0, 2**32 - 1))))), (5, b"\0\0\0\x10moov" * 30)]
    got = {r.doc_id: r for r in media_columns.described(spark.createDataFrame([(k, bytes(m)) for k, m in rows], "doc_id long, media binary")).collect()}
    assert len(got) == 6 and all(got[k].error and got[k].keyframes is None for k in got)


# --- suffix arrays


def brute_removal(rows, length=50):
    first, out = {}, Counter()
    marks = []
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if first.setdefault(data[s : s + length], i) < i:
                gone[s : s + length] = b"\1" * length
        marks.append((i, data, gone))
    for i, data, gone in marks:
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("limits", [{}, {"hot_in_batch": 1, "hot": 2, "buckets": 3}])
def test_removal_is_exact(spark, sf, limits):
    docs = documents(spark, sf).select("doc_id", "text").repartition(5)
    assert Counter(tuple(r) for r in suffix_dedup.digests(docs, **limits).collect()) == brute_removal([tuple(r) for r in docs.collect()])


def test_removal_odd_rows(spark, odd, empty):
    got = Counter(tuple(r) for r in suffix_dedup.digests(odd.where("doc_id is not null")).collect())
    assert got == brute_removal([(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()])
    assert [r.n_removed for r in suffix_dedup.digests(odd).where("doc_id is null").collect()] == [0]
    cut = suffix_dedup.without_copies(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count() and cut.where("doc_id = 5 and text = ''").count() == 1
    assert suffix_dedup.digests(empty).count() == 0


def test_slices_cost_a_batch_little():
    """A batch has a row for every slice of the corpus, so what a row costs grows with the square of the input."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, 4000).astype(np.uint8).tobytes() for _ in range(50)]
    ids, zeros = np.arange(50), np.zeros(50, np.int32)
    name, index, start, count = suffix_dedup.runs(texts, 50)

    def sent(buckets):
        began = time.process_time()
        names = [r for r in suffix_dedup._batch_rows(texts, ids, zeros, 50, buckets, 512) if r[0] == suffix_dedup.NAMES]
        rows = list(suffix_dedup._bytes_rows(texts, index, name, ids[index], zeros[index], start, count, np.zeros(len(name), bool), 50, buckets))
        took = time.process_time() - began
        for kinds, found in ((suffix_dedup._SENT, rows), (suffix_dedup._NAMES, names)):
            parts = [suffix_dedup._unpacked(r[2], kinds) for r in found]
            got = [x for p in parts for x in zip(np.cumsum(p["doc"]).tolist(), p["start"].tolist(), p["count"].tolist(), strict=True)]
            assert sorted(got) == sorted(zip(ids[index].tolist(), start.tolist(), count.tolist(), strict=True))
        return len(names) + len(rows), took

    (few, quick), (many, slow) = sent(40), min((sent(40_000) for _ in range(3)), key=lambda x: x[1])
    assert many > 100 * few and slow - quick < many * 20e-6


def test_suffix_order_and_previous_factors():
    rng = np.random.default_rng(1)
    for length in (32, 50, 56):
        data = rng.integers(97, 99, 700).astype(np.uint8)
        data[300:420], data[600:680] = data[:120], data[20:100]
        starts = rng.integers(0, 700 - length + 1, 300)
        windows = [bytes(data[s : s + length]) for s in starts]
        same = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
        order, lcp = suffix_dedup.suffix_order(data, starts, length)
        assert order.tolist() == sorted(range(300), key=lambda i: windows[i])
        assert lcp.tolist() == [0] + [same(windows[a], windows[b]) for a, b in zip(order, order[1:], strict=False)]
        docs = rng.integers(0, 9, 300)
        got = suffix_dedup.longest_previous(docs[order], lcp, 20)
        for k, i in enumerate(order):
            best = max((same(windows[i], windows[j]) for j in range(300) if docs[j] < docs[i]), default=0)
            assert got[k] == (best if best >= 20 else 0)


def test_windows_of_a_very_frequent_name_are_sorted_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1400], data[2000:2300], data[3000:3200] = data[:400], 97, 97
    at, counts = np.array([0, 500, 900, 1500, 2000, 2900]), np.array([450, 300, 500, 3, 251, 400])
    docs = np.array([5, 2, 7, 2, 2, 9])
    want = suffix_dedup.later_copies(data, at, docs, counts, 50)
    firsts = {}
    for a, c, d in zip(at, counts, docs, strict=True):
        for k in range(a, a + c):
            w = bytes(data[k : k + 50])
            firsts[w] = min(d, firsts.get(w, d))
    assert want.tolist() == [bool(firsts[bytes(data[k : k + 50])] < d) for a, c, d in zip(at, counts, docs, strict=True) for k in range(a, a + c)] and 100 < want.sum()
    for part in (64, 300, 1000):
        monkeypatch.setattr(suffix_dedup, "SORTED", part)
        assert suffix_dedup.later_copies(data, at, docs, counts, 50).tolist() == want.tolist()


def test_long_repetitive_texts_take_little_memory():
    import tracemalloc

    texts = [b"a" * (2 << 20), b"a" * (2 << 20), b"ab" * (1 << 20)]
    tracemalloc.start()
    rows = list(suffix_dedup._batch_rows(texts, np.array([3, 1, 2]), np.zeros(3, np.int32), 50, 4, 512))
    assert tracemalloc.get_traced_memory()[1] < 250 << 20
    tracemalloc.stop()
    spans = [(int(d), int(a), int(b)) for kind, _, data, _ in rows if kind == suffix_dedup.RANGES for got in [suffix_dedup._unpacked(data, suffix_dedup._RANGE)] for d, a, b in zip(np.cumsum(got["doc"]), got["start"], got["end"], strict=True)]
    assert suffix_dedup.merged([(a, b) for d, a, b in spans if d == 3]) == [(0, 2 << 20)] and {d for d, _, _ in spans} == {3}


# --- components, SQL, pipeline


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(50)] + [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(45)] + [(7, 7), (3, 2)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in df.select(*want.columns).collect()) == Counter(want.fetchall())


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = documents(spark, sf)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf), "test")
        seen[name] = (before, docs)
    assert all(after.columns == documents(spark, sf).columns for _, after in list(seen.values())[:-1])
    before, after = seen["suffix-array dedup"]
    texts = {r.doc_id: r.text for r in after.collect()}
    for i, size, gone, _, sha in brute_removal([(r.doc_id, r.text) for r in before.collect()]):
        assert len(texts[i].encode()) <= size - gone and (hashlib.sha256(texts[i].encode()).hexdigest() == sha or len(texts[i].encode()) < size - gone)
    before, after = seen["SimHash near-dedup"]
    kept = {r.doc_id for r in after.collect()}
    first = {}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert kept <= set(first.values()) and len(kept) > 0.9 * len(first)
    assert seen["SentencePiece"][1].count() == seen["SentencePiece"][0].count()
    assert corpus_pipeline.run(spark, sf).count() == seen["SentencePiece"][1].count()


def test_cuts_inside_characters_make_no_new_one(spark):
    shared = "pack my box with five dozen jugs of liquor while 1234567890 foxes jump"
    docs = spark.createDataFrame([(1, f"aaaa é{shared}ш one"), (2, f"bbb ũ{shared}т two")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.without_copies(docs).collect()}
    assert got == {1: f"aaaa é{shared}ш one", 2: "bbb  two"}
    assert suffix_dedup.whole_characters("aéé b".encode(), [(2, 4), (6, 7)]) == [(1, 5), (6, 7)]


def test_pipeline_takes_odd_and_empty_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd.unionByName(odd.where("doc_id in (0, 7)"))), ("none", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        read = docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.written(stage(spark, docs, str(tmp_path / name)), "test")
            assert docs.columns == read.columns
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()
        assert (name == "none") == out.isEmpty()
    texts = [r.text for r in docs.collect()]
    assert texts == []


def test_discarded_tables_are_gone(spark):
    import os

    a, b = common.written(spark.range(3), "gone"), common.written(spark.range(4), "stays")
    path = a.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    common.discard(a, None, spark.range(2))
    assert not os.path.exists(path) and b.count() == 4
