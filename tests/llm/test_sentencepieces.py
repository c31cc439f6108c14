import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tideline.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", " ", "  ", "\n", "▁", "é", "漢", "🙂", "\x00", "<s>", "<0x0A>", "word", "ing", "   ", "\t", "\r\n", "123", "==", ";;", ".", "ﬁ", "　", "é", "    ", "Straße", "​"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(n):
    rng = random.Random(2)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 80))) for _ in range(n)] + ["", " ", "\n", "▁", " " * 300, "ab" * 4000, "x\n" * 50]


def test_agenda_is_the_library(library):
    with open(PATH, "rb") as f:
        v = sentencepieces.Vocabulary(f.read())
    texts = odd_texts(1500)
    assert [v.encode(t) for t in texts] == library.encode(texts)
    v.check("the word", v.encode("the word"))
    assert max(map(len, v.known)) <= sentencepieces.LONGEST


def test_short_and_long_agenda_agree():
    with open(PATH, "rb") as f:
        v = sentencepieces.Vocabulary(f.read())
    for t in odd_texts(300):
        unit = list(t.replace(" ", "▁"))
        assert v.short(list(unit)) == v.long(list(unit))


def test_a_wrong_id_is_noticed(spark):
    with open(PATH, "rb") as f:
        v = sentencepieces.Vocabulary(f.read())
    v.encode("hello world")
    v.check("hello", v.encode("hello"))
    v.known["▁world"] = (1, 2)  # as if remembered wrongly
    with pytest.raises(ValueError):
        v.check("hello world", v.encode("hello world"))
    v.fresh = [("▁hello", (1,))]  # as if encoded wrongly
    with pytest.raises(ValueError):
        v.check("", [])


def test_long_texts(spark, library):
    parts = ["some words of a long text ", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo", "漢字仮名"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "doc_id long, text string").selectExpr("doc_id", "repeat(text, 60000) AS text")
    got = {r["doc_id"]: r["ids_sha256"] for r in sentencepieces.encode(df, PATH, ids=False, decoded=False, digests=True).collect()}
    assert got == {i: hashlib.sha256(",".join(map(str, library.encode(p * 60000))).encode()).hexdigest() for i, p in enumerate(parts)}


def test_table(spark, library):
    texts = [*odd_texts(200), None, None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "y"), (0, texts[0], "z")], "doc_id long, text string, n_tokens string")
    got = sentencepieces.encode(df, PATH, digests=True).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "a b" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = library.encode(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepieces.encode(df.limit(0), PATH).count() == 0


def test_round_trip_keeps_columns(spark, library):
    df = spark.createDataFrame([(1, "a  b\nc", "en"), (2, None, None)], "doc_id long, text string, lang string")
    got = sorted(map(tuple, sentencepieces.round_trip(df, PATH).collect()))
    assert got == [(1, "a  b\nc", "en", len(library.encode("a  b\nc"))), (2, "", None, 0)]
