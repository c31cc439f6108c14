import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tideline.llm import simhash
from tideline.llm.components import components
from tideline.llm.textbytes import single_spaced, slices, words

ODD = ["", None, " \n\t", "a", "a b", "A  b\tC d", "a b c d", "é\x0bß x \x0c y z", "x" * 5000, "w " * 3000, "a b c d e " * 40]


def shingles(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])


def brute(text, k=4):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_words_and_spacing():
    texts = ["a bc\n d", "", "x", "y  z "]
    ((_, _, data, off),) = slices(pa.array(texts))
    starts, ends, first = words(data, off)
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == [b"a", b"bc", b"d", b"x", b"y", b"z"]
    assert first.tolist() == [0, 3, 3, 4, 6]
    text, a, b = single_spaced(data, starts, ends)
    assert text.tobytes() == b"a bc d x y z " and [text[i:j].tobytes() for i, j in zip(a, b, strict=True)] == [b"a", b"bc", b"d", b"x", b"y", b"z"]


def test_slices_cover_all_rows():
    rng = random.Random(3)
    texts = ["é" * rng.randrange(0, 30) for _ in range(200)]
    got = []
    for lo, hi, data, off in slices(pa.array(texts).slice(7), most=50):
        got += [data[off[i] : off[i + 1]].tobytes().decode() for i in range(hi - lo)]
    assert got == texts[7:]


def test_fingerprints_are_those_of_brute_force():
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("the Of AND to in é ß x1").strip() + str(rng.randrange(9)) for _ in range(rng.randrange(1, 600))) for _ in range(60)]
    out = np.concatenate([simhash.fingerprints_of(d, o, 4) for _, _, d, o in slices(pa.array(texts), most=3000)])
    assert out.tolist() == [brute(t) for t in texts]


def classes(values, radius):
    """Union-find over all pairs."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_links_span_the_same_classes(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 120, dtype=np.int64).astype(np.uint64)
    near = base[:80] ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64))
    all_ = np.unique(np.concatenate([base, near, near ^ np.uint64(6), np.array([0], np.uint64)]))
    want = classes([int(v) for v in all_], radius)
    for split in (None, all_ % np.uint64(2) == 0):
        edges = [simhash.links_in(all_, None, radius)] if split is None else [simhash.links_in(all_[split], None, radius), simhash.links_in(all_[~split], None, radius), simhash.links_in(all_[split], all_[~split], radius)]
        ids = {int(v): i for i, v in enumerate(all_)}
        parent = list(range(len(all_)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for x, y in edges:
            for p, q in zip(x, y, strict=True):
                i, j = find(ids[int(p)]), find(ids[int(q)])
                parent[max(i, j)] = min(i, j)
        assert [find(i) for i in range(len(all_))] == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (12, 11), (20, 20), (None, 5), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35), (35, 36)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10} | dict.fromkeys(range(30, 37), 30)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    texts = [long, long + " tail", long.replace("w1 ", "w2 ", 1), "other words here now", None, "", "  ", "other words here now", *ODD]
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)] + [(0, long, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _fp string")
    got = simhash.near_duplicates(df).collect()
    prints = [brute(r[1]) for r in rows]
    cls = classes(prints, 4)
    want = sorted((str(rows[i][0]), f"{prints[i]:016x}", min(r[0] for r, c in zip(rows, cls, strict=True) if c == cls[i] and r[0] is not None)) for i in range(len(rows)))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.one_of_each(df).collect()
    assert len(kept) == len(set(cls))
    assert {r["doc_id"] for r in kept} == {w[2] for w in want}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.one_of_each(df).count() == 0


def test_blocks_hold_all_cells_and_lose_no_pair():
    rng = np.random.default_rng(8)
    fp = np.unique(np.concatenate([rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64), np.zeros(1, np.uint64)]))
    c = simhash.counts_of(fp)
    assert c.sum(1).tolist() == [int(v).bit_count() for v in fp]
    number = ((c[:, 0].astype(int) * 17 + c[:, 1]) * 17 + c[:, 2]) * 17 + c[:, 3]
    ids, n = np.unique(number, return_counts=True)
    places, lo, hi = simhash.blocks_of(list(zip(ids.tolist(), n.tolist(), strict=True)), 64)
    assert sorted(p[0] for p in places) == ids.tolist() and len(lo) > 20
    block = {cell: first for cell, first, _ in places}
    for i in range(0, 3000, 7):  # pairs near enough are in blocks near enough
        near = np.flatnonzero(np.abs(c - c[i]).sum(1) <= 4)
        b = [block[int(v)] for v in number[near]]
        assert (simhash.apart(lo[b], hi[b], lo[block[int(number[i])]], hi[block[int(number[i])]]) <= 4).all()
    big, lo, hi = simhash.blocks_of([(5, 1000), (6, 1)], 64)
    assert big == [(5, 0, 16), (6, 16, 1)] and len(lo) == 17


def test_many_blocks(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 700, dtype=np.int64)
    near = base[:300] ^ (1 << rng.integers(0, 62, 300)) ^ (1 << rng.integers(0, 62, 300))
    fp = np.unique(np.concatenate([base, near]))
    links = simhash.near_links(spark.createDataFrame([(int(v),) for v in fp], "_fp long"), 4, least=50)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    want = classes([int(v) & (1 << 64) - 1 for v in fp], 4)
    groups = {}
    for v, k in zip(fp.tolist(), want, strict=True):
        groups.setdefault(k, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_a_long_text_and_hot_copies(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same words here again' ELSE concat_ws(' ', transform(sequence(1, 20), k -> hex(xxhash64(id, k)))) END AS text")
    rows = rows.unionByName(spark.range(2).selectExpr("5000 + id AS doc_id", "repeat('some words of a very long text ', 600000) AS text"))  # 19 MB each
    got = simhash.near_duplicates(rows).toPandas().set_index("doc_id")
    assert (got.loc[range(0, 3000, 3), "component_id"] == 0).all() and got.loc[5001, "component_id"] == 5000
    assert simhash.one_of_each(rows).count() == 2002
