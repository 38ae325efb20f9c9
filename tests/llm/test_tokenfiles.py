"""Token files: Elias-Fano sequences, the array encoder against the library, files against a plain version."""

import random
import zlib

import numpy as np
import pytest

from ledgerline.llm import tokenfiles as T
from ledgerline.llm.common import filesystem, scratch


@pytest.mark.parametrize("n, top", [(0, 0), (1, 0), (1, 7), (1000, 10), (1000, 10**6), (2000, 2**50), (300, 3)])
def test_elias_fano(n, top):
    rng = random.Random(n + top)
    values = np.sort(np.array([rng.randrange(top + 1) for _ in range(n)], np.int64))
    code = T.EliasFano.from_bytes(T.EliasFano.of(values).to_bytes())
    assert [code[k] for k in range(n)] == values.tolist() == code.slice(0, n).tolist()
    assert code.slice(n // 3, n // 2).tolist() == values[n // 3 : n // 2].tolist()
    with pytest.raises(IndexError):
        code[n]
    if n >= 1000:  # about 2 + log2(u / n) bits a value
        assert len(code.to_bytes()) < n * (2.5 + max(0, np.log2(top / n))) / 8 + 64


def test_encoder_equals_the_library(monkeypatch):
    rng = random.Random(3)
    letters = "a b\t\n 'sS'll're 12三١   .,!\x1c\x85　é´`'d’\U0001f600\U0001d49c\x00ʼ\U000e0001"
    texts = ["", " ", "  ", "'s", "a  b\t\n c'll x'S 12三   x  ", " 'tis <|endoftext|>x", "it's we're 'something' ''s"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["x" * 3000 + " y" * 3000 + "  \n" * 100, "éa b'll " * 2000 + "\U000e0001"]
    monkeypatch.setattr(T, "BLOCK", 500)
    path = T.public_vocabulary()
    own = T.Encoder(path, T.classes_of(path), most_known=300)
    for at_once in (200, 1 << 20):
        assert all(g.tolist() == own.whole.encode(t, add_special_tokens=False).ids for t, g in zip(texts, own.encode(texts, at_once)))


def plain(rows, path):
    from tokenizers import Tokenizer

    tok, out, at = Tokenizer.from_file(path), [], 0
    tok.encode_special_tokens = True
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in T.op11_token_files(spark, sf).collect())
    assert got == plain(rows, T.public_vocabulary())


def test_files_of_odd_rows_in_any_partitions(spark):
    rows = [(5, "five"), (None, "x y"), (2**62, None), (-(2**62), ""), (5, "five"), (5, "other"), (7, "seven " * 40000), (None, None), (9, "\U000e0001")]
    docs = spark.createDataFrame([(i, t, "clash", 1, "h") for i, t in rows], "doc_id bigint, text string, ids string, shard int, h string")
    path = T.public_vocabulary()
    seen = []
    for parts in (1, 5):
        out = scratch(spark, "tok-test")
        files = T.write_tokens(docs.repartition(parts), out, rows_per_shard=2, verify_every=1).collect()
        got = sorted(T.read_tokens(spark, out, ids=True).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [None, None, -(2**62), 5, 5, 5, 7, 9, 2**62] and len(files) > 2
        assert [(r.start, r.n_tokens) for r in got] == [(s, n) for _, s, n, _ in plain([(r.doc_id, t) for r, t in zip(got, texts(got, path))], path)]
        assert all(r.ids[-1] == 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
        seen.append([(r.doc_id, r.ids_crc32) for r in got] + sorted((f.file, f.sha1) for f in files))
    assert seen[0] == seen[1]
    fs, base = filesystem(out)
    name = next(f for f in files if f.documents > 1).file
    with fs.open_input_file(f"{base}/{name}") as stream:  # random access: one document by select
        f = T.TokenFile(stream, stream.size())
        assert f.ids(*f.span(f.n - 1))[-1] == 0 and f.span(0)[0] == 0
    none = scratch(spark, "tok-none")
    assert T.write_tokens(docs.limit(0), none).count() == 0 and T.read_tokens(spark, none).count() == 0


def texts(rows, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [tok.decode(list(r.ids)[:-1], skip_special_tokens=False) for r in rows]
