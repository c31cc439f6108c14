"""Benchmark decontamination by template canonicalisation.

Words lose case and outer punctuation; scripts without spaces are cut to
characters. Numbers, names (a capital and small letters; words of capitals
alone are words) and units (after a number) become typed placeholders, so that
a question with other values gives the same template. A capital that begins a
sentence or line may be a name's or not: such a word is read both ways, in
items and documents. Windows of a template's words are hashed, in every
reading, and joined between documents and benchmark items; for each pair the
slots' values must map consistently: one value of the item stands for one value
in the document (two values may come to be equal). Windows of an item with few
plain words (and items of few words) say too little as templates: their words
and values themselves are hashed, and found in documents that hold the same.

Document windows are first held against a table of bits, sized by the number
of the items' windows, so that only few windows leave the tasks; the hash join
in Spark decides. Windows that more than ``COMMON`` items have are joined in a
second step, for pairs of a document and an item that share one of the item's
telling windows alone: those that the fewest items have, of which a document
with enough of the item cannot miss all.

Defined cases
- null or empty texts and items, and items without a letter or digit: no windows, never flagged.
- items of fewer than ``LEAST_WORDS`` words, or without a window that has enough plain
  words: flagged where their words and values stand as they are. Items shorter than a window are one window.
- repeated rows: rows of one id and text are one document; rows of one item id and text one item.
- null document ids: one document for each text; null item ids likewise.
- empty documents or benchmark: no rows. Texts are read whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.textbytes import LOWER, mix, slices, span_hashes, words
from tideline.session import bounded_batches, cut, fresh_name, written

#: Words of a window; words of it that are no placeholders, and words of an item, at least for it to be a template.
WINDOW, PLAIN, LEAST_WORDS = 8, 4, 5
#: Share of an item's windows that must be found, and of its slots' uses that must agree.
COVERAGE, AGREEMENT = 0.5, 0.8
#: The table that document windows are held against has ROOM entries for each window of an item, and 2 ** FEWEST to 2 ** MOST in all.
ROOM, FEWEST, MOST = 32, 16, 28
#: Items that may have a window before it is joined for pairs alone.
COMMON = 16

# Units that count as such after a number (fixed values).
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ml l litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degrees celsius fahrenheit mph kmh hz khz mhz w kw v a j kj cal kcal"
).split()

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_SLOT = np.array([11, 13, 17], np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # number, name, unit
_STEPS = np.array([pow(0xC2B2AE3D27D4EB4F, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the capitals of Latin-1."""
    out = LOWER[data]
    if len(data) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][wide] += 32
    return out


def _units() -> np.ndarray:
    text = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = words(text, np.array([0, len(text)]))
    return np.sort(span_hashes(text, starts, ends))


_UNIT_HASHES = _units()


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and sizes of characters of scripts without spaces, and the places of wide punctuation (three bytes each)."""
    at = np.flatnonzero(data >= 0xE0)
    at = at[at + 2 < len(data)]
    a, b, c = data[at], data[at + 1], data[at + 2]
    marks = (a == 0xE3) & (b == 0x80) | (a == 0xEF) & (b == 0xBC) & ((c <= 0x8F) | (c >= 0x9A) & (c <= 0xA0))
    thai = (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b >= 0x9E) & (b <= 0x9F))
    chinese = (a == 0xE3) & (b >= 0x81) | (a >= 0xE4) & (a <= 0xE9) | (a == 0xEF) & (b >= 0xA4) & (b <= 0xAB)
    rare = (a == 0xF0) & (b >= 0xA0) & (b <= 0xAF)
    wide = thai | chinese | rare
    return at[wide], np.where(rare, 4, 3)[wide], at[marks]


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes without wide punctuation, and starts, ends and first words; characters of scripts without spaces are words."""
    at, size, marks = _wide(data)
    if len(marks):
        data = data.copy()
        data[(marks[:, None] + np.arange(3)).ravel()] = 32
    starts, ends, first = words(data, off)
    if len(at):
        edge = np.unique(np.concatenate([at, at + size]))
        word = np.searchsorted(starts, edge, "left") - 1
        edge = edge[(word >= 0) & (edge < ends[word])]
        starts, ends = np.sort(np.concatenate([starts, edge])), np.sort(np.concatenate([ends, edge]))
        first = np.searchsorted(starts, off)
    return data, starts, ends, first


def template(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical words, their values, whether they are slots, whether they may be names too, and each row's first word (rows + 1)."""
    data, starts, ends, first = _words(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool), first
    kind = _KIND[data]
    at = np.arange(len(data), dtype=np.int64)
    head = np.minimum.accumulate(np.where(kind > 0, at, len(data))[::-1])[::-1][starts]
    tail = np.maximum.accumulate(np.where(kind > 0, at, -1))[ends - 1] + 1
    real = head < ends  # words with a letter or a digit
    last = data[ends - 1]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(starts), bool)  # does a sentence begin here?
    opens[1:] = np.isin(last[:-1], (46, 33, 63, 58)) | (lines[starts[1:]] != lines[ends[:-1]])
    opens[first[:-1][first[:-1] < len(starts)]] = True
    base = np.concatenate([[0], np.cumsum(real)])
    first = base[first]
    head, tail, opens = head[real], tail[real], opens[real]
    low = _lowered(data)
    value = span_hashes(low, head, tail)
    a = data[head]
    b = data[np.minimum(head + 1, len(data) - 1)]
    capital = ((a >= 65) & (a <= 90)) | ((a == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97))
    small = (data >= 97) & (data <= 122)
    small[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x9F)
    smalls = np.concatenate([[0], np.cumsum(small)])
    number = kind[head] == 2
    capital &= smalls[tail] > smalls[head]
    name = capital & ~opens
    unit = np.zeros(len(head), bool)
    near = np.flatnonzero(number[:-1]) + 1 if len(head) else np.zeros(0, int)
    near = near[~np.isin(near, first)]
    unit[near] = np.isin(value[near], _UNIT_HASHES) & ~number[near]
    word = np.where(number, _SLOT[0], np.where(unit, _SLOT[2], np.where(name, _SLOT[1], value)))
    return word, value, number | name | unit, capital & opens & ~unit, first


def _sums(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and sums of the windows of ``size`` words, none over a row's end."""
    n = max(len(word) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += word[k : k + n] * _STEPS[k]
    ok = np.ones(n, bool)
    for edge in first[1:-1]:
        ok[max(0, edge - size + 1) : edge] = False
    at = np.flatnonzero(ok)
    return at, h[at]


def windows(word: np.ndarray, slot: np.ndarray, either: np.ndarray, first: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """First words and hashes of the windows of ``size`` words with enough plain ones, none over a row's end.

    Once for every reading: the bits of the last number say which words of ``either`` are names in it.
    In the first, which has every window that any has, none are.
    """
    at, h = _sums(word, first, size)
    plain = np.concatenate([[0], np.cumsum(~slot)])
    ok = plain[at + size] - plain[at] >= min(PLAIN, size) if len(at) else np.zeros(0, bool)
    at, h = at[ok], h[ok]
    yield at, mix(h + np.uint64(size)), 0
    if not len(at):
        return
    change = _SLOT[1] - word

    def read(at: np.ndarray, h: np.ndarray, plain: np.ndarray, named: int, begin: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for k in range(begin, size):
            more = np.flatnonzero(either[at + k] & (plain > min(PLAIN, size)))
            if len(more):
                to = at[more], h[more] + change[at[more] + k] * _STEPS[k], plain[more] - 1, named | 1 << k
                yield to[0], mix(to[1] + np.uint64(size)), to[3]
                yield from read(*to, k + 1)

    open_ = np.concatenate([[0], np.cumsum(either)])
    some = open_[at + size] > open_[at]
    at = at[some]
    yield from read(at, h[some], plain[at + size] - plain[at], 0, 0)


def exact_windows(value: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all windows of ``size`` words as they are, none over a row's end."""
    at, h = _sums(value, first, size)
    return at, mix(h + np.uint64(size + 2 * WINDOW))


def _marked(h: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Are both of a hash's bits set, that of its low end in the first table and that of its high end in the second?"""
    bits = int(8 * len(one)).bit_length() - 1
    a, b = (h & np.uint64((1 << bits) - 1)).astype(np.int64), (h >> np.uint64(64 - bits)).astype(np.int64)
    return (one[a >> 3] >> (a & 7) & 1).astype(bool) & (two[b >> 3] >> (b & 7) & 1).astype(bool)


def _rows(doc: pa.RecordBatch, lo: int, row: np.ndarray, at: np.ndarray, h: np.ndarray, named: np.ndarray | int, value: np.ndarray, slot: np.ndarray, first: np.ndarray, size: int, totals: tuple[np.ndarray, np.ndarray] | None = None, typed: bool = True) -> pa.RecordBatch:
    """One row for each window: the row's keys, hash, place in the text, values of its slots, and for items where in the window these are."""
    span = at[:, None] + np.arange(size)
    held = slot[span] | (np.reshape(named, (-1, 1)) >> np.arange(size) & 1 > 0)
    flat = value[span][held].view(np.int64)
    ends = np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int32)
    slots = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    take = pa.array(lo + row)
    cols = [doc.column(0).take(take), doc.column(1).take(take), pa.array(h.view(np.int64)), pa.array(at - first[row]), slots]
    names = ["_id", "_key", "_window", "_at", "_slots"]
    if totals is not None:
        mark = size if typed else -size
        where = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(held)[1].astype(np.int32)))
        cols, names = [*cols, where, *(pa.array(t[row]) for t in totals), pa.array(np.full(len(row), mark, np.int32))], [*names, "_where", "_total", "_typed_total", "_size"]
    return pa.RecordBatch.from_arrays(cols, names=names)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every window of every item in every reading: _item, _item_key, _window, _at, _slots, _where, _total, _typed_total, _size.

    _size is below zero for windows of the words as they are; _total counts all windows of the item, _typed_total its templates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(2)):
                word, value, slot, either, first = template(data, off)
                n = np.diff(first)
                few = np.concatenate([[0], np.cumsum(~slot & ~either)])  # words that are plain in every reading
                bare = np.zeros(len(slot), bool)
                for size in range(1, window + 1):

                    def own(at: np.ndarray, size: int = size, n: np.ndarray = n, first: np.ndarray = first) -> tuple[np.ndarray, np.ndarray]:
                        row = np.searchsorted(first, at, "right") - 1
                        return row, (n[row] == size) if size < window else (n[row] >= size)

                    at, h = exact_windows(value, first, size)
                    row, right = own(at)
                    at, h, row = at[right], h[right], row[right]
                    typed = list(windows(word, slot, either, first, size)) if size >= LEAST_WORDS else []
                    of, right = own(typed[0][0] if typed else at[:0])
                    totals = np.bincount(row, minlength=hi - lo), np.bincount(of[right], minlength=hi - lo)
                    poor = (few[at + size] - few[at] < PLAIN) | (size < LEAST_WORDS)
                    yield _rows(batch, lo, row[poor], at[poor], h[poor], 0, value, bare, first, size, totals, typed=False)
                    for at, h, named in typed:
                        row, right = own(at)
                        yield _rows(batch, lo, row[right], at[right], h[right], named, value, slot, first, size, totals)

    kind = items.schema[id_col].dataType.simpleString()
    given = items.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_key"), F.col(text_col).cast("string").alias("_text")).dropDuplicates(["_key"])
    out = given.mapInArrow(run, f"_id {kind}, _key long, _window long, _at long, _slots array<long>, _where array<int>, _total long, _typed_total long, _size int")
    return out.withColumnsRenamed({"_id": "_item", "_key": "_item_key"})


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, agreement: float = AGREEMENT) -> DataFrame:
    """One row per document and item that it holds: the ids, n_windows, coverage, slot_agreement, reparameterised, _doc_key."""
    spark = docs.sparkSession
    asked = cut(item_windows(items, item_col, item_text_col, window))
    sizes = [r[0] for r in asked.select("_size").distinct().collect()]  # at most 2 * WINDOW values
    table = spark.sparkContext.broadcast(_table(asked))  # of 2 ** MOST bits at most, twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = table.value
        for batch in batches:
            for lo, _, data, off in slices(batch.column(2)):
                word, value, slot, either, first = template(data, off)
                bare = np.zeros(len(slot), bool)
                for size in sizes:
                    for at, h, named in windows(word, slot, either, first, size) if size > 0 else [(*exact_windows(value, first, -size), 0)]:
                        hit = _marked(h, one, two)
                        if hit.any():
                            at, h = at[hit], h[hit]
                            row = np.searchsorted(first, at, "right") - 1
                            if size < 0:  # once for each text: they have no slots that could differ
                                order = np.lexsort((h, row))
                                new = np.ones(len(h), bool)
                                new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                                at, h, row = at[order][new], h[order][new], row[order][new]
                            yield _rows(batch, lo, row, at, h, named, value, slot if size > 0 else bare, first, abs(size))

    kind = docs.schema[id_col].dataType.simpleString()
    given = bounded_batches(docs).select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    found = cut(given.mapInArrow(run, f"_id {kind}, _key long, _window long, _at long, _slots array<long>"))
    theirs = asked.select("_item", "_item_key", "_window", F.col("_at").alias("_item_at"), F.col("_slots").alias("_item_slots"), "_where", "_total", "_typed_total", (F.col("_size") > 0).alias("_typed"))
    pair = ["_key", "_item_key"]
    theirs = cut(_judged(theirs, coverage))
    near, far = theirs.filter(F.col("_telling") | (F.col("_f") <= COMMON)), theirs.filter(~F.col("_telling") & (F.col("_f") > COMMON))
    joined = found.join(near, "_window")
    if not far.isEmpty():  # a matter of the benchmark alone
        pairs = joined.filter("_telling").select(*pair).distinct()
        joined = joined.unionByName(found.join(pairs.join(far, "_item_key"), ["_key", "_window"]))
    # windows that meet in several readings count once, as templates if they can, in that of the fewest slots; the others' slots are equal words
    met = joined.groupBy(*pair, "_at", "_item_at").agg(
        F.first("_id").alias("_id"),
        F.first("_item").alias("_item"),
        F.first("_total").alias("_total"),
        F.first("_typed_total").alias("_typed_total"),
        F.max("_typed").alias("_typed"),
        F.min_by(F.struct("_item_slots", "_slots", "_where"), F.struct(~F.col("_typed"), F.size("_slots"))).alias("_both"),
    )
    met = cut(met.select("*", "_both.*"))

    share = met.groupBy(*pair).agg(
        F.first("_id").alias("_id"),
        F.first("_item").alias("_item"),
        F.countDistinct("_item_at").alias("n_windows"),
        F.countDistinct(F.when(F.col("_typed"), F.col("_item_at"))).alias("_n_typed"),
        F.first("_total").alias("_total"),
        F.first("_typed_total").alias("_typed_total"),
    )
    # of all windows, or of the templates alone, as the others are found in no text with other values
    covered = F.greatest(F.col("n_windows") / F.col("_total"), F.when(F.col("_typed_total") > 0, F.col("_n_typed") / F.col("_typed_total")))
    share = share.withColumn("coverage", covered).filter(F.col("coverage") >= coverage)
    # a value of the item at one place of the text: how many of its uses agree on the commonest value there; a slot is one use, in however many windows it is
    slots = met.select(*pair, (F.col("_at") - F.col("_item_at")).alias("_shift"), "_item_at", F.explode(F.arrays_zip("_item_slots", "_slots", "_where")).alias("_s"))
    slots = slots.groupBy(*pair, "_shift", (F.col("_item_at") + F.col("_s._where")).alias("_slot")).agg(F.first("_s._item_slots").alias("_theirs"), F.first("_s._slots").alias("_ours"))
    uses = slots.groupBy(*pair, "_shift", "_theirs", "_ours").agg(F.count(F.lit(1)).alias("_n"))
    each = uses.groupBy(*pair, "_shift", "_theirs").agg(F.max("_n").alias("_most"), F.sum("_n").alias("_all"), F.max(F.col("_theirs") != F.col("_ours")).alias("_other"))
    agreed = each.groupBy(*pair).agg((F.sum("_most") / F.sum("_all")).alias("_agreement"), F.max("_other").alias("_other"))
    judged = share.join(agreed, pair, "left").withColumn("slot_agreement", F.coalesce("_agreement", F.lit(1.0)))
    return judged.filter(F.col("slot_agreement") >= agreement).select(
        F.col("_id").alias(id_col),
        F.col("_item").alias(item_col),
        "n_windows",
        "coverage",
        "slot_agreement",
        F.coalesce("_other", F.lit(False)).alias("reparameterised"),
        F.col("_key").alias("_doc_key"),
    )


def _judged(theirs: DataFrame, coverage: float) -> DataFrame:
    """The items' windows with _f, in how many items each is, and _telling: a document that has so much of the item that it counts has one of these.

    Of T places of windows ceil(coverage T) must be found, so one of any T - ceil(coverage T) + 1 is;
    those are telling whose windows the fewest items have. The same goes for the templates alone.
    """
    shared = theirs.groupBy("_window").agg(F.countDistinct("_item_key").alias("_f"))
    each = theirs.join(shared, "_window")
    spots = each.groupBy("_item_key", "_item_at", "_total", "_typed_total").agg(F.max("_f").alias("_all"), F.max(F.when(F.col("_typed"), F.col("_f"))).alias("_own"))
    place = lambda f: F.row_number().over(Window.partitionBy("_item_key").orderBy(F.asc_nulls_last(f), "_item_at"))
    spots = spots.withColumns({"_nth": place("_all"), "_nth_own": place("_own")})
    spare = lambda n: F.col(n) - F.ceil(F.col(n) * coverage - 1e-9) + 1
    telling = (F.col("_nth") <= spare("_total")) | F.col("_own").isNotNull() & (F.col("_nth_own") <= spare("_typed_total"))
    return each.join(spots.select("_item_key", "_item_at", telling.alias("_telling")), ["_item_key", "_item_at"])


def _table(asked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of bits over all item windows, by the low and the high end of their hashes, made in Spark."""
    bits = min(max((asked.count() * ROOM).bit_length(), FEWEST), MOST)
    ends = F.array(F.struct(F.lit(0).alias("k"), F.col("_window").bitwiseAND(F.lit((1 << bits) - 1)).alias("at")), F.struct(F.lit(1).alias("k"), F.shiftrightunsigned("_window", 64 - bits).alias("at")))
    each = asked.select(F.explode(ends).alias("e")).select("e.k", F.shiftright("e.at", 6).alias("word"), F.expr("shiftleft(1L, CAST(e.at & 63 AS INT))").alias("bit"))
    got = each.groupBy("k", "word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2 ** bits / 32 rows
    tables = np.zeros((2, 1 << bits - 6), np.int64)
    tables[got["k"].to_numpy(np.int64), got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return tables[0].view(np.uint8), tables[1].view(np.uint8)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The rows of docs that hold no item.

    The keys of those that do are written first, so that their size is known when the
    anti-join is planned: texts move only if the keys are too many to broadcast.
    """
    key = fresh_name(docs, "_doc_key")
    gone = written(contaminated(docs, items, id_col, text_col, **how).select(F.col("_doc_key").alias(key)).distinct(), "contaminated")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
