import random

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash


def brute_print(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, fp) -> id -> least id of its component, all pairs compared."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, fa) in enumerate(rows):
        for b, fb in rows[:k]:
            if bin(fa ^ fb).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


TEXTS = ["", None, " \t\n", "One", "one two", "ONE two three", "one two three four", "é É ß x", "a\x0bb\x0cc d", "the " * 70000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    got = simhash.fingerprint(None if text is None else text.encode())
    assert got & (2**64 - 1) == brute_print(text)


def near_prints(n, seed):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(max(1, n // 6))]
    out = set()
    while len(out) < n:
        x = rng.choice(seeds)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("max_bucket", [3, 16384])
def test_components_equal_all_pairs(spark, max_bucket):
    prints = near_prints(400, 7)
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp bigint")
    found = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(simhash.near_links(nodes, max_bucket=max_bucket)).collect()}
    expected = brute_components([(i, p) for i, p in enumerate(prints)])
    group = {}
    for i, p in enumerate(prints):
        group.setdefault(expected[i], set()).add(found.get(p, p))
    assert all(len(v) == 1 for v in group.values())
    assert len({next(iter(v)) for v in group.values()}) == len(group)


def test_bucket_links_in_small_steps():
    fps = np.array(near_prints(300, 3), np.uint64)
    bucket = np.repeat([0, 1], [200, 100])
    expected = [brute_components([(i, int(fps[i])) for i in r]) for r in (range(200), range(200, 300))]
    for step in (50, 1 << 17):
        parent = simhash.bucket_links(fps, bucket, np.ones(300, bool), list(range(64)), step=step)
        assert parent.tolist() == [expected[i >= 200][i] for i in range(300)]


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(120)], "a bigint, b bigint")
    assert simhash.components(links).select("root").distinct().count() == 1


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    expected = brute_components(prints)
    got = simhash.op5_simhash(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", expected[i]) for i, p in prints)


def test_nulls_ties_and_empty(spark):
    rows = [(5, "x"), (3, "x"), (3, "x"), (None, "x"), (9, None), (8, " "), (None, "lonely text here"), (None, "another lonely text")]
    docs = spark.createDataFrame([(i, t, "e", "s", 1, "clash") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (None, None), (None, None)], key=str)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "x"), (8, " "), (None, "lonely text here"), (None, "another lonely text")], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
