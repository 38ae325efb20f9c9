import random

from ledgerline.llm import langid, nearcopies

ROWS = "doc_id bigint, text string, lang string"


def test_nothing_learned_keeps_texts_with_letters(spark):
    for labels in ((None, None), (None, "en")):  # no label; a label on a text without letters only
        rows = [(1, "the cat", labels[0]), (2, "שלום", None), (3, "12 !?", labels[1]), (4, None, None), (5, "", None)]
        docs = spark.createDataFrame(rows, ROWS)
        kept = langid.keep_known(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_script_without_labels_stays(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "שלום עולם", None), (3, "12 !?", None)]
    assert sorted(r.doc_id for r in langid.keep_known(spark.createDataFrame(rows, ROWS)).collect()) == [1, 2]


def test_latin_words_in_a_script_without_labels_stay(spark):
    chinese = "".join(chr(0x4E00 + k * 7) for k in range(400))
    rows = [(1, "the cat sat on the mat with an iPhone in the USA", "en"), (2, chinese, None), (3, chinese + " iPhone", None), (4, chinese[:200] + " USA " + chinese[200:], None), (5, None, "en")]
    assert sorted(r.doc_id for r in langid.keep_known(spark.createDataFrame(rows, ROWS)).collect()) == [1, 2, 3, 4]


def test_texts_in_another_language_than_their_label_go(spark):
    rng = random.Random(3)
    words = {"en": "the cat sat on that mat with this hat and then thought of other things which were there".split(), "de": "der hund liegt im garten und schläft nicht weil ein vogel über das haus fliegt".split()}
    say = lambda lang, n=40: " ".join(rng.choice(words[lang]) for _ in range(n))
    right = [(k, say(lang), lang) for k, lang in enumerate(["en", "de"] * 20, 100)]
    copy = right[0][1]  # English, and the row of the smaller id says German
    mixed = f"{say('en', 5)} {say('de', 60)} {say('en', 5)}"
    odd = [(1, copy, "de"), (2, mixed, "en"), (3, say("de"), None), (4, say("en"), "xx"), (5, "...", "xx"), (6, mixed, "de")]
    kept = langid.keep_known(spark.createDataFrame(right + odd, ROWS))
    found = {r.doc_id for r in kept.collect()}
    assert found == {r[0] for r in right} | {3, 4, 6}
    # what follows differs: of the two copies the rightly labelled one is left
    assert {r.doc_id for r in nearcopies.drop_near_copies(kept).collect() if r.text == copy} == {100}
