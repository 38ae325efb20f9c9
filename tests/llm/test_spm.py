import pytest

from ledgerline.llm import spm


@pytest.fixture(scope="module")
def bpe():
    with open(spm.public_model(), "rb") as f:
        return f.read()


def unigram():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{i:02X}>", 0, 6) for i in range(256)]
    pieces += [(p, s, 1) for p, s in [("▁", -2.0), ("▁the", -1.5), ("the", -3.0), ("t", -4.0), ("h", -4.1), ("e", -4.2), ("▁a", -2.5), ("a", -4.3), ("at", -3.3), ("he", -3.4), ("<", -6.0), ("s", -4.5), (">", -6.1)]]
    for p, s, kind in pieces:
        m.pieces.add(piece=p, score=s, type=kind)
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = True
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    return m.SerializeToString()


TEXTS = [*spm.PROBES, "the that the <s> heat", "x" * 40000, "word " * 20000, "  lead and trail  ", "tab\tnew\nline"]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_parity_and_round_trip(bpe, kind):
    model = bpe if kind == "bpe" else unigram()
    built = spm.rebuild(model)
    assert spm.differing(model, built, TEXTS) == []
    own = spm.Codec(built)
    assert own.decode(own.encode([*TEXTS, None])) == [*(t.replace(spm.MARK, " ") for t in TEXTS), None]  # a mark in a text is read back as a space
    assert own.encode(TEXTS, length=7, at_once=50) == own.encode(TEXTS, length=1 << 30)


def test_whole_table_parity(spark, sf, bpe):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    assert spm.differing(bpe, spm.rebuild(bpe), [r.text for r in rows]) == []


def test_rows(spark, bpe):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "same", 0), (3, "same", 0)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.encoded.ids, r.encoded.n_ids, r.encoded.round_trip) for r in spm.encode_documents(docs, bpe).collect())
    assert got[0] == (1, None, None, None) and got[1] == (2, [], 0, True) and got[2] == got[3] and got[2][3]
    back = spm.decode_documents(spm.encode_documents(docs, bpe).select("doc_id", "encoded.ids"), bpe)
    assert sorted((r.doc_id, r.text) for r in back.collect() if r.text is not None) == [(2, ""), (3, "same"), (3, "same")]
    assert spm.encode_rows(docs.limit(0)).count() == 0


def test_refused_models(bpe):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(bpe)
    m.pieces.add(piece="own", score=0, type=4)
    with pytest.raises(ValueError):
        spm.rebuild(m.SerializeToString())
