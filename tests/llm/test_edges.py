"""Clashing names, repeated ids, long texts, skewed groups and settings of the session."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import langid, lm, mixing, nearcopies, simhash, toolcalls, urlfilter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, *clash):
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)
    for k, c in enumerate(clash):
        df = df.withColumn(c, F.lit(k))
    return df


ROWS = [(1, "the cat sat on the mat", "en", "a"), (2, "der hund liegt im garten", "de", None), (2, "another text of the same id", "en", "a"), (1, "the cat sat on the mat", "en", "a"), (3, None, None, "b"), (None, " ", "en", "b")]


@pytest.mark.parametrize("stage,rows", [(langid.keep_known, 4), (nearcopies.drop_near_copies, 4), (simhash.drop_near_duplicates, 4), (mixing.mix_rows, None)])
def test_stages_take_any_column_names(spark, stage, rows):
    clash = ["whole", "limit", "ds", "_copies", "_copy", "_k", "_key", "_language", "key", "more", "_Key_", "node", "bucket", "root", "component_id", "fp", "a.b"]
    named = docs(spark, ROWS, *clash)
    got = stage(named)
    found = got.collect()
    assert got.columns == named.columns and all(r[c] == k for r in found for k, c in enumerate(clash)) and rows in (None, len(found))
    assert {(r.doc_id, r.text) for r in found} <= {r[:2] for r in ROWS}
    assert stage(named.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_told_apart_by_text(spark):
    kept = nearcopies.drop_near_copies(docs(spark, ROWS))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, ROWS[0][1]), (2, ROWS[1][1]), (2, ROWS[2][1]), (3, None)], key=str)


def test_near_copies_meet_in_chunks(spark):
    rng = random.Random(5)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(120)], []
    for k in range(90):  # edited copies, from close to far, and pages of one template that are below 0.8
        words = list(base)
        for p in rng.sample(range(120), 1 + k % 9):
            words[p] = f"x{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(words), "en", "s"))
    for _ in range(40):
        rows.append((len(rows), " ".join(base[:80] + [f"y{rng.randrange(10**9)}" for _ in range(25)]), "en", "s"))
    from test_nearcopies import plain_kept

    want = plain_kept([r[:2] for r in rows])
    assert {r.doc_id for r in nearcopies.drop_near_copies(docs(spark, rows), max_bucket=16).collect()} == want


def test_fingerprints_of_pairs_are_within_reach():
    rng = random.Random(3)
    missed = 0
    for n in (6, 9, 15, 40, 150, 600):
        for _ in range(40):
            shared = [rng.getrandbits(64) for _ in range(n)]
            odd = n // 4
            own = lambda k: [rng.getrandbits(64) for _ in range(k)]
            import numpy as np

            a, b = (np.unique(np.array(shared + own(k), np.uint64)) for k in (odd // 2, odd - odd // 2))
            x, y = nearcopies.wide_print(a)[None, :], nearcopies.wide_print(b)[None, :]
            missed += not nearcopies._within(x, y, np.array([len(a)]), np.array([len(b)]), 80)[0]
    assert missed <= 5  # of 240 at exactly the wanted similarity


@pytest.mark.parametrize("radius", [3, 7, 40, 63, 64, 127])
def test_sliced_distances_equal_counted_ones(radius):
    import numpy as np

    rng = np.random.default_rng(radius)
    a, b = rng.integers(0, 1 << 64, (70, 4), np.uint64), rng.integers(0, 1 << 64, (150, 4), np.uint64)
    b[:70] = a
    for k in range(150):
        for p in rng.integers(0, 252, rng.integers(0, 200)):
            b[k, p // 64] ^= np.uint64(1) << np.uint64(p % 64)
    groups, asked = np.sort(rng.integers(0, 5, 150)), rng.integers(0, 6, 70)
    mask = np.array([~np.uint64(0)] * 3 + [(np.uint64(1) << np.uint64(60)) - np.uint64(1)], np.uint64)
    near = np.bitwise_count((a[:, None] ^ b[None]) & mask).sum(axis=2) <= radius
    for ga, gb, fits in ((None, None, near), (asked, groups, near & (asked[:, None] == groups[None]))):
        got = [(i, j) for q, r in simhash.sliced_within(a, b, radius, 252, ga, gb, step=64) for i, j in zip(q.tolist(), r.tolist())]
        assert len(got) == len(set(got)) and set(got) == set(zip(*(x.tolist() for x in np.nonzero(fits))))


def test_components_of_a_long_chain(spark):
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert simhash.components(links).select("root").distinct().count() == 1


def test_long_texts(spark, tmp_path):
    long = "Ünder the häge " * 60_000
    rows = [(1, long, "en", "a"), (2, "short text here", "en", "a")]
    df = docs(spark, rows)
    assert {r.doc_id: r.size for r in mixing.mix(df).collect()} == {1: 180_000, 2: 3}
    assert {r.doc_id: r.n_tokens for r in lm.score_documents(df, F.lit(False), F.col("doc_id") == 2).collect()} == {1: 180_001, 2: 4}
    pages = df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://example.com/de/"), F.col("text")).alias("url"), F.col("text").alias("html"))
    warc.write_archive(pages, str(tmp_path / "w"))
    assert {r.page_id: r.payload_bytes for r in warc.read_archive(spark, str(tmp_path / "w")).collect()} == {1: len(long.encode()), 2: 15}
    judged = urlfilter.filter_urls(pages, urlfilter.OP10_RULES).collect()
    assert {r.page_id: (r.rule, len(r.path)) for r in judged} == {1: ("example.com/de/", len(long) + 4), 2: ("example.com/de/", 19)}
    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long), (1, 2, "user", long)], "conv_id bigint, turn bigint, role string, text string")
    link = [r for r in toolcalls.link_tool_calls(toolcalls.tool_messages(talk), toolcalls.tool_schemas(spark)).collect() if r.status == "linked"][0]
    assert len(link.canonical) > len(long)


def test_archive_is_the_same_under_any_settings(spark, tmp_path):
    pages = spark.range(400).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("page_id"), F.lit("http://a/").alias("url"), F.repeat(F.md5((F.col("id") % 350).cast("string")), 40).alias("html"))
    sums, key = [], "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    try:
        for k in ("2", "4", "64"):
            spark.conf.set(key, k)
            manifest = warc.write_archive(pages.repartition(int(k)), str(tmp_path / k), rows_per_shard=20)
            sums.append(sorted((r.file, r.records, r.sha1) for r in manifest.collect()))
    finally:
        spark.conf.set(key, old)
    assert sums[0] == sums[1] == sums[2] and len(sums[0]) >= 15 and max(n for _, n, _ in sums[0]) < 80  # null and repeated ids are in several shards
    assert warc.read_archive(spark, str(tmp_path / "4")).count() == 400


def test_long_chain_of_calls(spark):
    calls = spark.range(10_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("call_id"), F.col("id").alias("turn"), F.lit(0).alias("pos"))
    waits = calls.filter("turn > 0").select("conv_id", "call_id", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("after"))
    began = time.time()
    assert toolcalls.levels(calls, waits).agg(F.max("level")).first()[0] == 9999 and time.time() - began < 150


def test_joined_rules_equal_the_trie(spark):
    rng = random.Random(1)
    hosts, folders = ["a.com", "b.a.com", "com", "x.org", "org"], ["/", "/a/", "/a/b", "/a/b/", "/a/b/c/d", "", "/a"]
    rules = sorted({(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(folders)) for _ in range(14)}, key=lambda r: r[1:])
    rules = list({r[1:]: r for r in rules}.values())
    urls = [(k, f"http://{rng.choice(['a.com', 'b.a.com', 'c.b.a.com', 'com', 'y.x.org', 'z.net', ''])}{rng.choice(['', '/', '/a', '/a/', '/a/b', '/a/bc', '/a/b/c/d/e', '/A/b?x=/a/b/', '/a//b/'])}") for k in range(200)]
    df = spark.createDataFrame(urls, "page_id bigint, url string").withColumn("_won", F.lit(1))
    a = sorted(tuple(r) for r in urlfilter.filter_urls(df, rules).select("page_id", "rule", "verdict", "_won").collect())
    b = sorted(tuple(r) for r in urlfilter.filter_urls(df, rules, max_broadcast_rules=0).select("page_id", "rule", "verdict", "_won").collect())
    assert a == b and len({x[1] for x in a}) > 4
