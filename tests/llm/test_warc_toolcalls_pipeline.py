import base64
import gzip
import hashlib
import json
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import langid, simhash, spm, toolcalls, warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


ROWS = [(1, "http://a/", "same"), (5, "http://b/", "same"), (3, None, "same"), (5, "http://b/", "same"), (7, "u r\nl", None), (8, "x", ""), (9, "y", "é" * 9000), (None, "n", "same"), (None, "n", "only null"), (10, "z", "unique\r\n\r\n")]


def pages(spark):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in ROWS], "page_id bigint, url string, html string, digest string")


@pytest.mark.parametrize("least", [0, 100])
def test_archive_round_trip(spark, tmp_path, least):
    out = str(tmp_path / "w")
    warc.write_archive(pages(spark), out, min_revisit_bytes=least, roll_bytes=600)
    got = sorted((str(r.page_id), r.record_type, r.payload_bytes, r.payload_digest, str(r.refers_to), bytes(r.payload or b"")) for r in warc.read_archive(spark, out, payloads=True).collect())
    want, seen = [], set()
    for i, _, h in ROWS:
        b = (h or "").encode()
        group = [j for j, _, x in ROWS if (x or "").encode() == b]
        top = max((j for j in group if j is not None), default=None)
        revisit = len(group) > 1 and len(b) >= least and not (i == top and (i, b) not in seen)
        seen.add((i, b))
        want.append((str(i), "revisit" if revisit else "response", len(b), digest(b), str(top) if revisit else "None", b"" if revisit else b))
    assert got == sorted(want)
    assert not os.path.exists(f"{out}/_temporary")


def test_same_rows_same_files(spark, tmp_path):
    sums = []
    for k, df in enumerate((pages(spark), pages(spark).repartition(7))):
        manifest = warc.write_archive(df, str(tmp_path / str(k)), rows_per_shard=3, roll_bytes=400)
        sums.append(sorted((r.file, r.records, r.sha1) for r in manifest.collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 3
    for name, _, sha in sums[0]:
        raw = (tmp_path / "0" / name).read_bytes()
        assert hashlib.sha1(raw).hexdigest() == sha and gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


def test_damage_is_found(spark, tmp_path):
    out = str(tmp_path / "w")
    name = warc.write_archive(pages(spark).filter("page_id = 10"), out).first().file
    data = gzip.decompress((tmp_path / "w" / name).read_bytes()).replace(b"unique", b"Unique")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "w" / name).write_bytes(z.compress(data) + z.flush())
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, out).collect()


def test_empty_archive(spark, tmp_path):
    warc.write_archive(pages(spark).limit(0), str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0


# -- tool calls -----------------------------------------------------------------------------------------------------


def call(i, name="search", args=None, after=()):
    return {"id": i, "name": name, "arguments": args if args is not None else {"query": "q"}, "after": list(after)}


def test_links(spark):
    m = [
        (1, 0, "assistant", None, json.dumps([call("a", args={"query": "x", "limit": 2, "deep": {"b": [1, {"z": 1, "y": 2}], "a": None}}), call("b", after=["a", "gone"])]), None),
        (1, 1, "tool", "ra", None, "a"), (1, 2, "tool", "again", None, "a"), (1, 3, "tool", 'quo"te', None, "b"), (1, 4, "tool", "lost", None, "zz"), (1, 4, "tool", None, None, None),
        (2, 5, "assistant", None, json.dumps([call("a", after=["c"]), call("c", after=["a"]), call("d", after=["c"]), call("e", "nope"), call("f", args={"limit": "many"}), call("g", args={"query": 1.5, "limit": 1})]), None), (2, 6, "assistant", None, json.dumps([call("a", "late")]), None),
        (2, 1, "tool", "early", None, "e"), (3, 0, "assistant", None, "not json", None), (None, 0, "assistant", None, json.dumps([call("a")]), None), (4, 0, "user", "hi", None, None),
        (5, 0, "assistant", None, '[{"id":"s","name":"search","arguments":[1],"after":null},{"id":"t","name":"search","arguments":{"query":"1","query":"2"}}]', None),
    ]
    df = spark.createDataFrame([(*x, 0) for x in m], "conv_id bigint, turn bigint, role string, text string, tool_calls string, tool_call_id string, level int")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link_tool_calls(df, toolcalls.tool_schemas(spark)).collect()}
    assert {k: (r.status, r.level, r.errors) for k, r in got.items() if k[0] == 1 and k[1]} == {
        (1, "a"): ("linked", 0, ["unknown:deep"]), (1, "b"): ("linked", 1, []), (1, "zz"): ("orphan_result", None, [])}
    assert json.loads(got[1, "a"].canonical)["result"] == "ra" and got[1, "a"].canonical.startswith('{"arguments":{"deep":{"a":null,"b":[1,{"y":2,"z":1}]},"limit":2,"query":"x"},"call_id":"a","level":0,"name"')
    assert json.loads(got[1, "b"].canonical) == {"arguments": {"query": "q"}, "call_id": "b", "level": 1, "name": "search", "result": 'quo"te', "turn": 0}
    assert {k[1]: (r.status, r.errors) for k, r in got.items() if k[0] == 2} == {
        "a": ("cycle", []), "c": ("cycle", []), "d": ("cycle", []), "e": ("early_result", ["unknown_tool"]), "f": ("no_result", ["missing:query", "type:limit"]), "g": ("no_result", ["type:query"])}
    assert (3, "a") not in got and not any(k[0] is None and r.turn is not None for k, r in got.items())
    assert got[5, "s"].errors == ["not_an_object"] == got[5, "t"].errors
    assert toolcalls.link_tool_calls(df.limit(0), toolcalls.tool_schemas(spark)).count() == 0


def test_topological_order(spark):
    rng = __import__("random").Random(2)
    calls, waits = [], []
    for conv in range(12):
        place = list(range(9))
        rng.shuffle(place)
        for k in range(9):  # a call waits for lower numbers only, but stands anywhere in the chat
            calls.append((conv, f"c{k}", (k if conv < 4 else place[k]) // 2, (k if conv < 4 else place[k]) % 2))
            waits += [(conv, f"c{k}", f"c{j}") for j in rng.sample(range(k), min(k, 2))]
    c = spark.createDataFrame(calls, "conv_id bigint, call_id string, turn bigint, pos int")
    got = toolcalls.levels(c, spark.createDataFrame(waits, "conv_id bigint, call_id string, after string")).join(c, ["conv_id", "call_id"]).collect()
    order = {(r.conv_id, r.call_id): (r.level, r.turn, r.pos) for r in got}
    assert len(order) == len(calls) and all(order[v, b] < order[v, a] for v, a, b in waits)


def test_derived_calls_wait_in_all_ways(spark, sf):
    got = toolcalls.op7_tool_calls(spark, "/root/testdata/sf0.01").collect()
    assert {"linked", "cycle", "no_result"} <= {r.status for r in got} and max(r.level or 0 for r in got) >= 3
    turns = {}
    for r in got:
        if r.level is not None:
            turns.setdefault(r.conv_id, []).append((r.level, r.turn))
    assert any([t for _, t in sorted(v)] != sorted(t for _, t in v) for v in turns.values())  # reordered


# -- pipeline -------------------------------------------------------------------------------------------------------


def plain_pipeline(rows):
    """The four stages by plain Python over (doc_id, text, lang, source)."""
    from test_text_ops import code, plain_grams, plain_predict

    counts = {}
    for _, text, lang, _ in rows:
        if lang and text and any(c.isalpha() for c in text):
            counts.setdefault(lang, __import__("collections").Counter()).update(plain_grams(text))
    profiles = {k: [g for g, _ in sorted(((code(g), n) for g, n in c.items()), key=lambda x: (-x[1], x[0]))[: langid.TOP]] for k, c in counts.items()}
    known = [r for r in rows if plain_predict(profiles, r[1], langid.TOP) != "und" and langid.Profiles(profiles, langid.TOP).predict(r[1])[1] >= 0.05]
    from test_nearcopies import plain_kept

    stay = plain_kept([(r[0], r[1]) for r in known])
    return [r for r in known if r[0] in stay]


def plain_mix(rows):
    """Copies by document, from the definition: targets by filling up, then the hash order up to the budget."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    sources = sorted({s for _, _, _, s in rows}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    whole = {s: sum(size[i] for i, _, _, x in rows if x == s) for s in sources}
    left, target = set(sources), {}
    while left:
        level = (1.5 * sum(whole.values()) - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if 2 * whole[s] <= weight[s] * level}
        target |= {s: 2 * whole[s] for s in full} if full else {s: weight[s] * level for s in left}
        left = left - full if full else set()
    copies = {}
    for s in sources:
        times = int(target[s] // whole[s]) if whole[s] else 0
        budget, taken, limit = target[s] - times * whole[s], 0, -1
        own = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i, _, _, x in rows if x == s}
        for h in sorted(set(own.values())):
            words = sum(size[i] for i in own if own[i] == h)
            if taken + words > budget and not taken + words - budget < budget - taken:
                break
            taken, limit = taken + words, h
            if taken > budget:
                break
        copies |= {i: times + (own[i] <= limit) for i in own}
    return copies


def test_pipeline_equals_plain_stages(spark, sf):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    single = plain_pipeline(rows)
    copies = plain_mix(single)
    with open(spm.public_model(), "rb") as f:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    want = sorted((i, tuple(sp.encode(t))) for i, t, _, _ in single for _ in range(copies[i]))
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "mixing", "tokens"] and simhash.BITS == 64
    assert docs.select(F.count("*")).first()[0] > 0
