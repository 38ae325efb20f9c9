import random

import corpus_pipeline
from ledgerline.llm import nearcopies


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Ids that stay: all pairs by exact Jaccard, components by relabelling."""
    sets, root = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or both and both / len(sets[a] | sets[b]) >= 0.8):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {i for i in root if root[i] == i}


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns
    return {r.doc_id for r in out.collect()}


def text(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, words, at):
    words = list(words)
    for k in at:
        words[k] = f"x{rng.randrange(10**9)}"
    return words


def edited(rng, at):
    rows = []
    for n, swaps in ((200, 4), (200, 2), (800, 8), (60, 1)):  # Jaccard 0.82 to 0.91
        for _ in range(25):
            words = text(rng, n)
            rows += [" ".join(copy) for copy in (words, changed(rng, words, rng.sample(range(n), swaps)))]
    rows += [None, " \n", "a b", "A  b"]
    return [(at + k, t) for k, t in enumerate(rows)]


def unlike(rng, at):
    rows = []
    for filler in (["-"], text(rng, 3), text(rng, 7), text(rng, 11)):  # own words, then one short line 60 times
        rows += [" ".join(text(rng, 300) + filler * 60) for _ in range(12)]
    return [(at + k, t) for k, t in enumerate(rows)]


def passages_and_chain(rng, at):
    passage, rows = text(rng, 300), []
    rows += [" ".join(passage + text(rng, rng.randrange(5, 70))) for _ in range(60)]  # below and above 0.8, in one group of common buckets
    words = text(rng, 200)
    for _ in range(30):  # a chain: each within reach of the next, its ends far apart
        rows.append(" ".join(words))
        words = changed(rng, words, rng.sample(range(200), 3))
    return [(at + k, t) for k, t in enumerate(rows)]


def test_made_groups_equal_all_pairs(spark):
    """Near copies are found, unlike documents stay, shared passages and chains link as all pairs say."""
    groups = [edited(random.Random(7), 0), unlike(random.Random(8), 1000), passages_and_chain(random.Random(9), 2000)]
    want = [plain_kept(g) for g in groups]
    assert len(want[0]) <= len(groups[0]) // 2 + 2 and len(want[1]) == len(groups[1]) and 1 < len(want[2]) < len(groups[2])
    assert kept(spark, sum(groups, [])) == set().union(*want)


def test_stage_equals_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert kept(spark, rows) == plain_kept(rows)
