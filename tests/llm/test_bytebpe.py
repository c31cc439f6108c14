import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from tideline.llm import bytebpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = ["a", "the", " ", "  ", "\n", "é", "漢字", "🙂", "\x00", "\x1c", "\x85", " ", "　", "'s", "'LL", "’t", "word", "ing", "   ", "\t", "\r\n", "123", "٣", "==", ";;", ".", "ﬁ", "é", "Straße", "​", "<|endoftext|>", "don't", "aaaaaaaa", "\U000e0001"]


def ranks():
    with open(PATH, "rb") as f:
        return bytebpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(), special_tokens={})


def odd_texts(n):
    rng = random.Random(4)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 80))) for _ in range(n)] + ["", " ", "\n", " " * 300, "ab" * 4000, "x\n" * 50, "\n\n x", "a  b", "'s's"]


def digest(ids):
    return hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_words_are_the_library(library):
    merges = bytebpe.Merges(ranks())
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeetaoin") for _ in range(rng.randrange(1, 60))) for _ in range(3000)] + ["a" * n for n in (2, 3, 7, 199, 201, 1000)] + ["漢" * 90, "ab" * 150]
    for w in words:
        b = w.encode()
        assert merges.encode(b) == library._encode_single_piece(b)
        if len(b) > 1:
            assert merges.short(b) == merges.long(b)


def test_every_split_is_the_library(spark, library):
    texts = [*odd_texts(600), *["".join(map(chr, [97, 32, c, 98, c, c, 49])) for c in range(1, 0x3000, 7) if not 0xD800 <= c < 0xE000], None, None]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "y"), (0, texts[0], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = bytebpe.round_trip(df, PATH, PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a b" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(ids), hashlib.sha256(text.encode()).hexdigest()), text
    assert bytebpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0


def test_both_engines_split_alike():
    full = regex.compile(PATTERN)
    split = bytebpe.splitter(PATTERN)
    for c in (*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x20000, 11)):
        text = f"a {chr(c)}b{chr(c)}{chr(c)} 1'll{chr(c)}  x "
        assert list(split(text)) == full.findall(text), hex(c)
    for other in (r"\p{Lu}?[\p{Ll}\p{M}]+|\S|\s+", r"[^\]\s]+|.", r"(?i:'s)|\p{N}{1,3}|[^\p{N}]"):
        for text in odd_texts(50):
            assert list(bytebpe.splitter(other)(text)) == regex.findall(other, text)


def test_small_blocks_give_the_same(spark, library):
    texts = odd_texts(60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1, 50, 1000):
        got = {r["doc_id"]: r["ids"] for r in bytebpe.encode(df, PATH, PATTERN, block=block).collect()}
        assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_long_texts(spark, library):
    parts = ["some words of a long text ", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo", "漢字仮名"]
    times = [400_000, 20_000, 20_000]
    df = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(zip(parts, times, strict=True))], "doc_id long, text string, n int").selectExpr("doc_id", "repeat(text, n) AS text")
    got = {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in bytebpe.round_trip(df, PATH, PATTERN).collect()}
    assert got == {i: (digest(library.encode_ordinary(p * n)), hashlib.sha256((p * n).encode()).hexdigest()) for i, (p, n) in enumerate(zip(parts, times, strict=True))}


def test_decode_by_both_joins(spark, library):
    rows = [(1, library.encode_ordinary("one 漢 two"), "k"), (2, [], "k"), (3, None, None), (None, [0, None, 50255], "k"), (1, [123], "l")]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, lang string")
    want = sorted((str(i), lang, library.decode_bytes([x for x in ids or [] if x is not None])) for i, ids, lang in rows for lang in [str(lang)])
    for most in (bytebpe.TABLE_BYTES, 0):
        got = bytebpe.decode(df, PATH, keep=("lang",), table_bytes=most).collect()
        assert sorted((str(r["doc_id"]), str(r["lang"]), bytes(r["decoded"])) for r in got) == want
        for bad in (50_300, -1):
            with pytest.raises(Exception, match="an id has no token"):
                bytebpe.decode(spark.createDataFrame([(1, [5, bad])], "doc_id long, ids array<int>"), PATH, table_bytes=most).collect()


def test_a_word_is_in_one_bucket_and_once_in_a_block(spark):
    df = spark.createDataFrame([(i, f"the same words again{i}") for i in range(50)], "doc_id long, text string").repartition(5)
    rows = bytebpe.exploded(df, PATTERN, "doc_id", "text", 7, block=100).collect()
    found = [(w, r["_block"], r["_bucket"]) for r in rows if r["_bucket"] is not None for w in bytebpe.unpacked_words(r["_sizes"], r["_data"])]
    blocks = {r["_block"] for r in rows if r["_bucket"] is None}
    same = [(b, k) for w, b, k in found if w == b" same"]
    assert len(blocks) > 5 and sorted(b for b, _ in same) == sorted(blocks) and len({k for _, k in same}) == 1
    assert len(found) == len({(w, b) for w, b, _ in found})


def test_words_are_remembered_within_bounds(spark, library, monkeypatch):
    merges = bytebpe.Merges(ranks())
    calls = []
    monkeypatch.setattr(bytebpe, "_merges", lambda lines: type("M", (), {"encode": lambda self, w: calls.append(w) or merges.encode(w)})())
    monkeypatch.setattr(bytebpe, "bounded_batches", lambda df: df)

    class Frame:  # runs the task's function here
        def repartition(self, *_):
            return self

        select = repartition

        def mapInArrow(self, f, _):  # noqa: N802
            words = [b" a", b" bb", b" a"]
            blob = bytebpe.packed_words(words)
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 3], pa.int32()), pa.array([blob[0]] * 2), pa.array([blob[1]] * 2)], names=["_block", "_bucket", "_sizes", "_data"])
            return [(bytebpe.unpacked(r["_sizes"]).tolist(), bytebpe.unpacked(r["_data"]).tolist()) for out in f(iter([batch, batch])) for r in out.to_pylist()]

    ids = [library.encode_ordinary(w) for w in (" a", " bb", " a")]
    want = ([len(i) for i in ids], sum(ids, []))
    assert bytebpe.encoded_words(Frame(), b"", 3) == [want] * 4 and sorted(calls) == [b" a", b" bb"]
    monkeypatch.setattr(bytebpe, "REMEMBERED", 300)
    assert bytebpe.encoded_words(Frame(), b"", 3) == [want] * 4


def test_packing():
    for numbers in ([], [0], [1, 255, 256, 65536, 2**32 - 1], list(range(1000))):
        assert bytebpe.unpacked(bytebpe.packed(np.array(numbers, np.uint32))).tolist() == numbers
    for pieces in ([], [b""], [b"a", b"", b"\x00" * 300, b"b"]):
        assert bytebpe.unpacked_words(*bytebpe.packed_words(pieces)) == pieces
    rng = np.random.default_rng(1)
    edges = [0xBF, 0xC0, 0xC1, 0xC0 + 0x2FFF, 0xC0 + 0x3000, 0xC0 + 0x3001, 0xC0 + 0x3000 + (1 << 20) - 1]
    for numbers in ([], [0], edges, [*edges, edges[-1] + 1], rng.integers(0, 200_000, 5000).tolist(), rng.integers(0, 300, 5000).tolist()):
        assert bytebpe.unpacked_ranks(bytebpe.packed_ranks(np.array(numbers, np.uint32))).tolist() == numbers
    for numbers, often in (([], 0), ([0, 1, 2], 0), ([0, 0, 1, 0, 2], 1), ([1, 0, 2, 0, 3, 1, 4], 2), ([0, 1, 0, 1], 2)):
        assert bytebpe.unpacked_positions(bytebpe.packed_positions(np.array(numbers, np.uint32), often)).tolist() == numbers
