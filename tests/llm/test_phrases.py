"""Phrase collocations against plain counting: both ways of passing numbers on, small rows, odd texts."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import phrases as P


def plain(rows, least, top=2000, longest=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {}
    for (lang, g), a in f.items():
        if len(g) > 1 and a >= least:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            found[lang, g] = (a, l, r, n[lang], score)
    inside = {(lang, g[i : i + k], v[0]) for (lang, g), v in found.items() for k in range(2, len(g)) for i in range(len(g) - k + 1)}
    out = []
    for lang in sorted(n):
        own = sorted(((-v[4], -v[0], " ".join(g).encode(), *v) for (x, g), v in found.items() if x == lang and (lang, g, v[0]) not in inside))
        out += [(lang, k, p.decode(), *v) for k, (_, _, p, *v) in enumerate(own[:top], 1)]
    return out


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"broadcast_rows": 0, "row_positions": 3000}])
def test_equals_plain_counting(spark, sf, how):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 11 > 0, F.col("lang")))
    want = plain([(r.text, r.lang) for r in docs.select("text", "lang").collect()], 8, top=300)
    assert len(want) > 200 and rows_of(P.collocations(docs, least=8, top=300, **how)) == sorted(want)


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)  # level 1 by join, later ones by broadcast
    rows = [(None, "en"), ("", "en"), (" \t., ", None), ("A a\ta  a A a", "en"), ("É é É", None), ("x y. z x y!x y", None), ("x y z\x0bx y z", ""), ("ab cd " * 30000, "long"), ("\x00 \x00 nul \x00 \x00", "en")] * 2
    docs = spark.createDataFrame([(t, c, "k", 1, 2) for t, c in rows], "text string, lang string, chunk string, freq int, n int").repartition(3)
    assert rows_of(P.collocations(docs, least=2)) == sorted(plain(rows, 2))
    assert P.collocations(docs.limit(0), least=2).count() == 0 == P.collocations(docs.filter("text = ''"), least=2).count()


def test_chunks_count_each_start_once():
    words = [f"w{k % 700}" for k in range(5000)]
    chunks, at = P.chunks_of(" ".join(words).encode())
    assert len(chunks) > 100 and len(at) == len(chunks)
    starts = 0
    for c in chunks.to_pylist():
        own = c.split()
        fire = [k for k, w in enumerate(own) if k and P.is_trigger([w.encode()])[0]]
        zone = fire[0] if fire else len(own)
        assert len(own) <= zone + 4 and words[starts : starts + len(own)] == own
        starts += zone
    assert starts == len(words)


def test_scores_are_exact(spark):
    big = 10**15 + 7
    row = spark.range(1).selectExpr(f"{big} AS a", f"{big * 9} AS n", f"array({big + 3}L) AS heads", f"array({big + 11}L) AS tails")
    got = row.selectExpr(P.score_sql(1, 2)).first()[0]
    assert got == 1000 * big * big * 9 // ((big + 3) * (big + 11))
