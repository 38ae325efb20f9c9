"""Language ID, mixing and URL filters."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import langid, mixing, urlfilter


# -- language ID ----------------------------------------------------------------------------------------------------


def plain_grams(text):
    """n-grams by slicing strings: runs of letters, each with a mark on both sides."""
    out = Counter()
    marked = "_" + "".join(c.lower()[0] if c.isalpha() else "_" for c in text) + "_"
    while "__" in marked:
        marked = marked.replace("__", "_")
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            g = marked[i : i + n]
            if "_" not in g[1:-1] and g != "_":
                out[g] += 1
    return out


def code(gram):
    return sum((1 if c == "_" else ord(c)) << (21 * k) for k, c in enumerate(gram))


@pytest.mark.parametrize("text", ["", "...", "a", "Ab, aB!", "été ÉTÉ straße", "x" * 50, "日本語 テスト", "a1b2c3 \U0001f600 Ω"])
def test_gram_counts(text):
    grams, counts = langid.ngram_counts(text)
    assert dict(zip(grams.tolist(), counts.tolist())) == ({code(g): n for g, n in plain_grams(text).items()} if any(c.isalpha() for c in text) else {})


def test_blocks_of_long_texts_count_alike():
    text = " ".join(random.Random(1).choice(["alpha", "beta", "gamma,", "über"]) for _ in range(3000))
    for a, b in zip(langid.ngram_counts(text), langid.ngram_counts(text, block=100)):
        assert a.tolist() == b.tolist()


def plain_predict(profiles, text, top):
    doc = [g for g, _ in sorted(((code(g), n) for g, n in plain_grams(text or "").items()), key=lambda x: (-x[1], x[0]))[:top]] if any(c.isalpha() for c in text or "") else []
    if not doc:
        return "und"
    far = lambda ranked: sum(abs(ranked.index(g) - k) if g in ranked else top for k, g in enumerate(doc))
    return min(sorted(profiles), key=lambda lang: far(profiles[lang]))


def test_query_accuracy_and_brute_force(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op9_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    learned = {}
    for r in got:
        d = docs[r.doc_id]
        if not r.held_out and d.lang and d.text:
            learned.setdefault(d.lang, Counter()).update(plain_grams(d.text) if any(c.isalpha() for c in d.text) else {})
    profiles = {lang: [g for g, _ in sorted(((code(g), n) for g, n in c.items()), key=lambda x: (-x[1], x[0]))[: langid.TOP]] for lang, c in learned.items()}
    for r in got[:60]:
        assert r.lang_pred == plain_predict(profiles, docs[r.doc_id].text, langid.TOP)


def test_language_edges(spark):
    rows = [(1, "the cat", "en"), (2, "le chat", "fr"), (3, None, "en"), (4, "", None), (5, "123 !?", "xx"), (6, "the cat", None), (6, "the cat", None)]
    docs = spark.createDataFrame([(i, t, c, 0) for i, t, c in rows], "doc_id bigint, text string, lang string, language int")
    profiles = langid.fit(docs)
    assert profiles.langs == ["en", "fr"]
    got = {r.doc_id: r.language for r in langid.predict(docs, profiles).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["en", "fr", "und", "und", "und", "en"]
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 6]
    assert langid.fit(docs.limit(0)).langs == [] and langid.predict(docs, langid.fit(docs.limit(0))).filter("language.lang_pred <> 'und'").count() == 0
    with pytest.raises(ValueError):
        langid.fit(docs, max_languages=1)


# -- mixing ---------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Dealing round by round: what exceeds a cap goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    got, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        give = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s, x in give.items():
            got[s] += x
            if got[s] >= cap * sizes[s] - 1e-12:
                left += got[s] - cap * sizes[s]
                got[s] = cap * sizes[s]
                open_.discard(s)
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 100, 100000]) for s in [None, "", "a", "B", "é", "\U0001f600", "z9"]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_mix_meets_targets(spark, sf):
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
    for docs in by.values():
        assert abs(sum(r.taken for r in docs) - docs[0].target) <= max(r.size for r in docs) / 2 + 1e-6


def test_mix_edges(spark):
    rows = [(1, "a b", None), (1, "a b", None), (2, None, "s"), (None, "c d e", "s"), (4, "", "t"), (5, "x " * 50, "u"), (6, "y", "u")]
    docs = spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], "doc_id bigint, text string, source string, h string")
    a, b = mixing.mix(docs).collect(), mixing.mix(docs.repartition(5)).collect()
    assert len(a) == len(rows) and sorted(map(str, a)) == sorted(map(str, b))
    same = [r.copies for r in a if r.doc_id == 1]
    assert same[0] == same[1]
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in a)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix_rows(docs.limit(0)).count() == 0


# -- URL filters ----------------------------------------------------------------------------------------------------


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "org", ""), ("block", "org", "/x"), ("block", "a.org", "/x/y"), ("allow", "a.org", "/x/y"), ("allow", "", "/z"), ("block", "b.org", "p")]


def plain_rule(host, path):
    fits = [(len(h.split(".")), len(p), a == "block", h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


def urls():
    rng = random.Random(4)
    hosts = ["net", "example.net", "a.example.net", "org", "a.org", "x.a.org", "EXAMPLE.net", "aorg", "b.org", "", "net.", "u@a.org:80"]
    paths = ["", "/", "/en", "/en/", "/en/q?x=/en/", "/x", "/xy", "/x/y", "/x/yz#f", "/z", "p", "?q", "#f"]
    return [None, "", "no scheme", "http://", "a://b://c/x", *(f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300))]


@pytest.mark.parametrize("most", [0, 100])
def test_rules_by_trie_and_by_join(spark, most):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls())], "page_id bigint, url string, rule string")
    for r in urlfilter.filter_urls(pages, RULES, max_broadcast_rules=most).collect():
        best = plain_rule(r.host, r.path)
        assert (r.rule, r.verdict) == ((best[3], best[4]) if best else (None, "allow")), (r.url, r.host, r.path)
    assert urlfilter.filter_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(pages, [], default="block").collect()} == {"block"}


def test_rules_from_a_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x/y")], "page_id bigint, url string")
    table = spark.createDataFrame(RULES, urlfilter.RULE_SCHEMA)
    assert [r.verdict for r in urlfilter.filter_urls(pages, table).collect()] == [r.verdict for r in urlfilter.filter_urls(pages, table, max_broadcast_rules=1).collect()] == ["block"]
