"""Language identification by prediction by partial matching.

For each language the counts of bytes after contexts of three, two, one and no
bytes are gathered from a sample of labelled texts. The statistics are then
frozen: escape method C with exclusion gives every byte a probability from the
longest context that holds it, down to equal shares of the byte values left.
As nothing adapts, the code length of a byte depends on its context alone. It
is looked up in a dense table of all contexts that the sample has while that
takes no more than ``TABLE_BYTES``; with more languages it is worked out from
the sorted counts, by binary search: the same lengths, and no context is left
out. A text's score is the exact sum over all its bytes, and the language with
the shortest code wins.

Defined cases
- null text, or text without a letter: ``und``, score 0.
- ties: the language that sorts first.
- bytes never seen in the sample: coded by escapes from every order.
- null languages are not learned; no learned language: ``und`` everywhere.
- null ids: not learned, not held out. Repeated rows: each is scored. Empty
  input: no rows. Texts are scored whole. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.textbytes import per_row, slices
from tideline.session import bounded_batches, ddl, fresh_name

#: Labelled texts of each language that the statistics are gathered from, bytes of them at most, and characters of one (in pieces spread evenly over it).
SAMPLE, SAMPLE_BYTES, TEXT_CHARS, PIECES = 400, 4_000_000, 100_000, 10
#: Languages that are learned at most: those with the most sampled texts, of equals the first by name.
LANGUAGES = 1000
#: Bytes up to which a worker's table is dense.
TABLE_BYTES = 64 << 20
#: Parts of a key that its sample is first chosen from.
SPREAD = 32
#: Bytes worked on at once.
STEP = 1 << 20
ORDER = 3


def contexts(sym: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The symbols one, two and three places before each; 0 before a text's start."""
    out = []
    for _ in range(ORDER):
        before = np.empty_like(sym)
        if len(sym):
            before[0] = 0
            before[1:] = sym[:-1] if not out else out[-1][:-1]
            before[off[:-1][off[:-1] < len(sym)]] = 0
        out.append(before)
    return out


def count(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context of three, byte) as base-257 numbers, 0 for no byte, and their counts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    sym = data.astype(np.int64) + 1
    one, two, three = contexts(sym, off)
    return np.unique(((three * 257 + two) * 257 + one) * 257 + sym, return_counts=True)


class Model:
    """Code lengths in bits of every byte in every context, for each language."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray], table_bytes: int = TABLE_BYTES) -> None:
        self.langs = langs
        seen = np.unique(np.concatenate([g % 257 for g in grams]))
        # symbol 0 stands before a text's start, the last symbol for all bytes that no sample has
        size = self.size = len(seen) + 2
        self.symbol = np.full(256, size - 1, np.int64)
        self.symbol[seen - 1] = np.arange(1, len(seen) + 1)
        to = np.zeros(257, np.int64)
        to[1:] = self.symbol
        keys = []  # per language: (three, two, one, next) in the small alphabet
        for g in grams:
            keys.append([to[g // 257**3], to[g // 257**2 % 257], to[g // 257 % 257], to[g % 257]])
        ids = np.unique(np.concatenate([(k[0] * size + k[1]) * size + k[2] for k in keys]))
        pairs = np.unique(ids % (size * size))
        # rows of the table: no context, one byte, two bytes, three bytes
        row1, row2, row3 = 1, 1 + size, 1 + size + len(pairs)
        self.table = None
        if (row3 + len(ids)) * size * len(langs) * 4 > table_bytes:
            self.sparse = [Counts(k, c, size) for k, c in zip(keys, counts, strict=True)]
            return
        # a pair's own rows of contexts of three; a pair or a three unknown to all stands for its last bytes
        self.pair = np.zeros(size * size, np.int32)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        self.of3 = np.tile(row2 - 1 + np.arange(len(pairs) + 1, dtype=np.int32)[:, None], (1, size))
        self.of3[self.pair[ids % (size * size)], ids // (size * size)] = row3 + np.arange(len(ids))
        table = np.empty((row3 + len(ids), size, len(langs)), np.float32)
        for l, (k, c) in enumerate(zip(keys, counts, strict=True)):
            dense = [np.zeros((n, size)) for n in (1, size, len(pairs), len(ids))]
            np.add.at(dense[0], (np.zeros(len(c), int), k[3]), c)
            np.add.at(dense[1], (k[2], k[3]), c)
            np.add.at(dense[2], (np.searchsorted(pairs, k[1] * size + k[2]), k[3]), c)
            np.add.at(dense[3], (np.searchsorted(ids, (k[0] * size + k[1]) * size + k[2]), k[3]), c)
            ups = [None, np.zeros(size, int), pairs % size, np.searchsorted(pairs, ids % (size * size))]
            self._code(table[:, :, l], dense, ups, [0, row1, row2, row3])
        self.table = table.reshape(-1, len(langs))

    @staticmethod
    def _code(out: np.ndarray, dense: list[np.ndarray], ups: list, first: list[int]) -> None:
        """Escape method C with exclusion, order by order from each context down."""
        for order, d in enumerate(dense):
            for lo in range(0, len(d), 4096):
                rows = np.arange(lo, min(lo + 4096, len(d)))
                bits, done = np.zeros((len(rows), d.shape[1])), np.zeros((len(rows), d.shape[1]), bool)
                spent = np.zeros(len(rows))
                at = rows
                for o in range(order, -1, -1):
                    c = np.where(done, 0, dense[o][at])  # what a longer context holds is excluded
                    n, kinds = c.sum(1), (c > 0).sum(1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        own = spent[:, None] - np.log2(c / (n + kinds)[:, None])
                        spent = np.where(n > 0, spent - np.log2(kinds / (n + kinds)), spent)
                    bits = np.where(c > 0, own, bits)
                    done |= c > 0
                    at = ups[o][at] if o else at
                left = np.maximum(256 - done.sum(1), 1)
                bits = np.where(done, bits, (spent + np.log2(left))[:, None])
                out[first[order] + rows] = bits

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code lengths: texts x languages."""
        sym = self.symbol[data]
        one, two, three = contexts(sym, off)
        if self.table is None:
            return np.stack([per_row(c.bits(three, two, one, sym), off) for c in self.sparse], 1)
        k = self.pair[two * self.size + one]
        row = np.where(k > 0, self.of3[k, three], 1 + one).astype(np.int64)
        cost = self.table[row * self.size + sym]
        return np.stack([per_row(cost[:, l].astype(np.float64), off) for l in range(len(self.langs))], 1)


def _grouped(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    ids, at = np.unique(key, return_inverse=True)
    return ids, np.bincount(at, weights=n, minlength=len(ids))


def _find(ids: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of keys among sorted ids, -1 for those that are not there."""
    at = np.minimum(np.searchsorted(ids, key), len(ids) - 1)
    return np.where(ids[at] == key, at, -1)


class Counts:
    """One language's counts by order, sorted by context and symbol, with every context's costs of coding and of escaping.

    What a context holds its shorter one holds too, so what is excluded below a context depends on
    that context alone: the counts left there are sums, kept by context.
    """

    def __init__(self, key: list[np.ndarray], n: np.ndarray, size: int) -> None:
        self.size = size
        whole = [key[3], key[2] * size + key[3], (key[1] * size + key[2]) * size + key[3], ((key[0] * size + key[1]) * size + key[2]) * size + key[3]]
        grams = [_grouped(k, n) for k in whole]
        self.grams = [ids for ids, _ in grams]
        self.own = [np.log2(c) for _, c in grams]
        self.contexts, totals, kinds = [], [], []
        for o, (ids, c) in enumerate(grams):
            ctx = ids // size
            known, at = np.unique(ctx, return_inverse=True)
            self.contexts.append(known)
            totals.append(np.bincount(at, weights=c))
            kinds.append(np.bincount(at).astype(float))
        self.alone = [_costs(t, k) for t, k in zip(totals, kinds, strict=True)]
        # an order's costs below a context of the next: without what that holds
        self.below = []
        for o in range(ORDER):
            ids, ctx = self.grams[o + 1], self.contexts[o + 1]
            short = ids % size ** (o + 1)  # the same symbol after the shorter context
            held = np.bincount(np.searchsorted(ctx, ids // size), weights=grams[o][1][np.searchsorted(self.grams[o], short)])
            up = np.searchsorted(self.contexts[o], ctx % size**o)
            self.below.append(_costs(totals[o][up] - held, kinds[o][up] - kinds[o + 1]))
        self.last = np.log2(256 - kinds[0][0])

    def bits(self, three: np.ndarray, two: np.ndarray, one: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """The code length of each symbol."""
        s = self.size
        ctx = [np.zeros_like(one), one, two * s + one, (three * s + two) * s + one]
        out, spent, done = np.zeros(len(sym)), np.zeros(len(sym)), np.zeros(len(sym), bool)
        longer = np.full(len(sym), -1)  # the context before, where it is known
        for o in range(ORDER, -1, -1):
            here = _find(self.contexts[o], ctx[o])
            code, escape = self.alone[o][0][here], self.alone[o][1][here]
            if o < ORDER:
                code, escape = (np.where(longer >= 0, b[longer], a) for b, a in zip(self.below[o], (code, escape), strict=True))
            gram = _find(self.grams[o], ctx[o] * s + sym)
            hit = ~done & (here >= 0) & (gram >= 0)
            out[hit] = (spent + code - self.own[o][gram])[hit]
            done |= hit
            spent = np.where(here >= 0, spent + escape, spent)
            longer = here
        return np.where(done, out, spent + self.last).astype(np.float32).astype(np.float64)


def _costs(total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 of what a count is out of, and the cost of an escape; nothing where nothing is left."""
    some = kinds > 0
    code = np.log2(np.where(some, total + kinds, 1))
    return code, np.where(some, code - np.log2(np.where(some, kinds, 1)), 0.0)


_models: dict[str, Model] = {}


def _model(version: str, sent: Broadcast) -> Model:
    """This worker's table, made once for a version of the counts; the last one is kept."""
    if version not in _models:
        _models.clear()
        _models[version] = Model(*sent.value)
    return _models[version]


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, is the fold."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def least_of_each(ids: DataFrame, key: str, sample: int) -> DataFrame:
    """The rows of each key with the ``sample`` least hashes (columns _h, _id).

    Taken from SPREAD parts of a key first and from what is left of these then, so that no
    task sees a whole key and none gets a sample from every partition of the input.
    """
    for part in ([key, F.pmod("_h", F.lit(SPREAD))], [key]):
        nth = F.row_number().over(Window.partitionBy(*part).orderBy("_h", "_id"))
        ids = ids.withColumn("_nth", nth).filter(F.col("_nth") <= sample).drop("_nth")
    return ids


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """(lang, gram, n): the frozen counts, from at most ``sample`` texts and ``sample_bytes`` bytes of each language.

    The sample is the texts whose ids have the least hashes, so it is the same at every
    run. Its ids are chosen first, each once; only one text of each is moved, TEXT_CHARS of
    it at most, to one task for a language.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col, folds, fold))
    rows = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(id_col).alias("_h"), F.col(text_col).cast("string").alias("_text"))
    ids = least_of_each(rows.select("_id", "_lang", "_h").distinct(), "_lang", sample)
    top = ids.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_lang").limit(LANGUAGES)
    chosen = ids.join(F.broadcast(top.select("_lang")), "_lang").select("_id", "_lang")  # sample * LANGUAGES rows at most
    piece = TEXT_CHARS // PIECES
    start = lambda k: F.floor(k * (F.length("_text") - piece) / (PIECES - 1)).cast("int") + 1
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substr(F.col("_text"), start(k), F.lit(piece))), "")
    part = F.when(F.length("_text") > TEXT_CHARS, spread).otherwise(F.col("_text"))
    texts = rows.join(F.broadcast(chosen), ["_id", "_lang"]).groupBy("_id", "_lang", "_h").agg(F.min(part).alias("_text"))

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_h", "_text"])
        texts = [t.encode("utf-8", "replace") for t in group["_text"]]
        keep = np.cumsum([0] + [len(t) for t in texts])[:-1] < sample_bytes
        g, n = count([t for t, k in zip(texts, keep, strict=True) if k])
        return pd.DataFrame({"lang": key[0], "gram": g, "n": n})

    grouped = texts.select("_lang", "_text", "_h").groupBy("_lang")
    return grouped.applyInPandas(gather, "lang string, gram long, n long").toPandas().sort_values(["lang", "gram"], ignore_index=True)


def predict(docs: DataFrame, counts: pd.DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, fold: int = 2) -> DataFrame:
    """id, held_out, lang_pred, score, bits_per_byte."""
    coded = _coder(docs, counts)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "held_out", "lang_pred", "score", "bits_per_byte"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, score, rate = coded(batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(score), pa.array(rate)], names=names)

    text = F.col(text_col).cast("string")
    given = docs.select(F.col(id_col), held_out(id_col, folds, fold).alias("_held"), text.alias("_text"), has_letter(text).alias("_letter"))
    return given.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep(docs: DataFrame, counts: pd.DataFrame, most_bits: float, least_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of docs in a learned language, with their columns as they are.

    That is: coded in at most ``most_bits`` bits a byte, and in one language clearly better than
    in the others: with a score of at least ``least_score``.
    """
    coded = _coder(docs, counts)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, score, rate = coded(batch.column(at), batch.column(batch.num_columns - 1))
            ok = np.array([s != "und" for s in said], bool) & (rate <= most_bits) & (score >= least_score)
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=docs_columns)

    docs_columns = docs.columns
    return docs.withColumn(fresh_name(docs, "_letter"), has_letter(F.col(text_col).cast("string"))).mapInArrow(run, ddl(docs))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _coder(docs: DataFrame, counts: pd.DataFrame) -> Callable[[pa.Array, pa.Array], tuple[list[str], np.ndarray, np.ndarray]]:
    """A function of texts and whether they have letters: languages, scores, bits a byte."""
    bounded_batches(docs)
    langs = sorted(counts["lang"].unique())
    parts = [counts[counts["lang"] == l] for l in langs]
    sent = docs.sparkSession.sparkContext.broadcast((langs, [p["gram"].to_numpy() for p in parts], [p["n"].to_numpy() for p in parts]))
    version = uuid.uuid4().hex

    def coded(texts: pa.Array, letters: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(texts)
        best, score, rate = np.zeros(n, int), np.zeros(n), np.zeros(n)
        for lo, hi, data, off in slices(texts, STEP) if langs else ():
            bits = _model(version, sent).bits(data, off)
            best[lo:hi] = bits.argmin(1)
            low = bits.min(1)
            score[lo:hi] = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
            rate[lo:hi] = low / np.maximum(np.diff(off), 1)
        known = np.array(letters.to_numpy(zero_copy_only=False), bool) & bool(langs)
        score[~known] = 0
        return [langs[b] if k else "und" for b, k in zip(best, known, strict=True)], score, rate

    return coded
