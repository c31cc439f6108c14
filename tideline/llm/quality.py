"""A quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Every passage is encoded from its
bytes and words: shares of byte classes, word lengths, repetition. Labels
belong to texts alone; gated attention (Ilse, Tomczak and Welling, 2018) learns
which passages carry them: a = softmax(w (tanh(V h) * sigmoid(U h))), and the
attended sum of the passages' representations is scored by a logistic unit.

The network is small and is fitted with numpy on the driver, on a sample of
labelled texts whose size has a bound. Encoding the sample and encoding and
scoring all texts happen in Spark tasks.

Defined cases
- null or empty text: one passage of zeros, scored like any other.
- texts of any length are encoded whole, in memory for their passages' features.
- a text with several labels (repeated rows): learned with its largest; scored once per row.
- null labels are not learned; no labels of one kind: every score is 0.5.
- null ids: scored, not learned. Empty input: no rows. Clashing names: only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.langid import held_out, least_of_each
from tideline.llm.textbytes import LOWER, slices, span_hashes, within, words
from tideline.session import bounded_batches, ddl

#: Words of a passage; passages whose bytes are counted at once.
PASSAGE, RUN = 64, 4096
#: Texts of each label, passages in all, and passages of one text, that the network is fitted on at most.
SAMPLE, SAMPLE_PASSAGES, TEXT_PASSAGES = 1200, 24_000, 100
HIDDEN, EPOCHS, RATE, DECAY = 16, 80, 0.03, 1e-4

#: Byte classes by their first member: lower case, capitals, digits, white space, bytes over 127, and marks one by one.
_MARKS = ".,;:!?|%#*&$-_@/\\<>(){}[]\"'=+~^`"
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[128:] = 5
for _k, _m in enumerate(_MARKS):
    _CLASS[ord(_m)] = 6 + _k
CLASSES = 6 + len(_MARKS)
FEATURES = CLASSES + 8


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and each row's first passage (rows + 1). A row without words has one passage of zeros."""
    starts, ends, first = words(data, off)
    n_words = np.diff(first)
    n = np.maximum(-(-n_words // PASSAGE), 1)
    base = np.concatenate([[0], np.cumsum(n)])
    x = np.zeros((base[-1], FEATURES), np.float32)
    if not len(starts):
        return x, base
    row = np.repeat(np.arange(len(n_words)), n_words)
    of = base[row] + (np.arange(len(starts)) - first[row]) // PASSAGE  # the passage of each word
    heads = np.flatnonzero(np.diff(of, prepend=-1))
    known = of[heads]
    size = (ends - starts).astype(np.float64)
    count = np.bincount(of, minlength=len(x))[known].astype(np.float64)
    # bytes from each passage's first word to the end of its last, so that nothing beyond it counts
    begin, stop = starts[heads], ends[np.append(heads[1:], len(of)) - 1]
    counts = np.empty((len(heads), CLASSES), np.int64)
    for lo in range(0, len(heads), RUN):
        a, z = begin[lo : lo + RUN], stop[lo : lo + RUN]
        own = np.repeat(np.arange(len(a)), np.diff(np.append(a, z[-1]))) * (CLASSES + 1)
        cls = _CLASS[data[a[0] : z[-1]]]
        cls[np.repeat(z[:-1], a[1:] - z[:-1]) - a[0] + within(a[1:] - z[:-1])] = CLASSES  # white space between passages
        counts[lo : lo + RUN] = np.bincount(own + cls, minlength=len(a) * (CLASSES + 1)).reshape(-1, CLASSES + 1)[:, :CLASSES]
    x[known, :CLASSES] = np.sqrt(counts / (stop - begin)[:, None])
    h = span_hashes(LOWER[data], starts, ends)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    new = np.ones(len(h))
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    capital = _CLASS[data[starts]] == 2
    marked = _CLASS[data[ends - 1]] > 5
    sums = lambda v: np.bincount(of, weights=v, minlength=len(x))[known] / count
    mean = sums(size)
    k = CLASSES
    x[known, k] = np.log1p(mean)
    x[known, k + 1] = np.log1p(np.sqrt(np.maximum(sums(size * size) - mean * mean, 0)))
    x[known, k + 2] = sums(again)
    x[known, k + 3] = np.bincount(of[order], weights=new, minlength=len(x))[known] / count
    x[known, k + 4] = sums(capital)
    x[known, k + 5] = sums(marked)
    x[known, k + 6] = sums(size == 1)
    x[known, k + 7] = count / PASSAGE
    return x, base


@dataclass
class Network:
    """Weights of the encoder, the gated attention and the logistic unit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # encoder E, e; attention V, U, w; output o, b

    def forward(self, x: np.ndarray, base: np.ndarray, times: Callable = np.matmul) -> tuple:
        e, eb, v, u, w, o, b = self.weights
        z = np.clip((x - self.mean) * self.scale, -8, 8)
        h = np.tanh(times(z, e) + eb)
        t, s = np.tanh(times(h, v)), 1 / (1 + np.exp(-times(h, u)))
        g = times(t * s, w[:, None])[:, 0]
        row = np.repeat(np.arange(len(base) - 1), np.diff(base))
        g = np.exp(g - np.maximum.reduceat(g, base[:-1])[row])
        a = g / np.bincount(row, weights=g)[row]
        ah = a[:, None] * h
        bag = np.stack([np.bincount(row, weights=ah[:, k]) for k in range(ah.shape[1])], 1)
        return 1 / (1 + np.exp(-np.clip(times(bag, o[:, None])[:, 0] + b, -30, 30))), (z, h, t, s, a, bag, row)

    def score(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Scores of bags, to the last bit the same whatever bags stand beside them."""
        return self.forward(x, base, _times)[0]


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, term after term: a row's sums do not depend on how many rows there are, as those of blocked products may."""
    out = x[:, :1] * w[0]
    for k in range(1, len(w)):
        out += x[:, k : k + 1] * w[k]
    return out


def loss_and_gradient(net: Network, x: np.ndarray, base: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted cross-entropy of bags and its gradient by each array of weights."""
    p, (z, h, t, s, a, bag, row) = net.forward(x, base)
    e, eb, v, u, w, o, b = net.weights
    dl = (p - y) * share
    d_bag = dl[:, None] * o
    d_a = (d_bag[row] * h).sum(1)
    d_g = a * (d_a - np.add.reduceat(a * d_a, base[:-1])[row])
    d_ts = d_g[:, None] * w
    d_t, d_s = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
    d_h = (a[:, None] * d_bag[row] + d_t @ v.T + d_s @ u.T) * (1 - h * h)
    loss = -float((share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    return loss, [z.T @ d_h, d_h.sum(0), h.T @ d_t, h.T @ d_s, (t * s).T @ d_g, bag.T @ dl, dl.sum()]


def fit(x: np.ndarray, base: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Adam on the mean cross-entropy, both labels given the same weight."""
    rng = np.random.default_rng(seed)
    mean, sd = x.mean(0), x.std(0)
    d = x.shape[1]
    shapes = [(d, HIDDEN), (HIDDEN,), (HIDDEN, HIDDEN), (HIDDEN, HIDDEN), (HIDDEN,), (HIDDEN,), ()]
    start = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
    start[4], start[5] = rng.normal(0, 0.5, HIDDEN), rng.normal(0, 0.5, HIDDEN)
    net = Network(mean, 1 / np.maximum(sd, 1e-3), start)
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    m, v2 = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, EPOCHS + 1):
        _, grads = loss_and_gradient(net, x, base, y, share)
        rate = RATE * min(1, 2 * (1 - step / (EPOCHS + 1)))
        for i, g in enumerate(grads):
            g = g + DECAY * net.weights[i]
            m[i], v2[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v2[i] + 0.01 * g * g
            net.weights[i] = net.weights[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v2[i] / (1 - 0.99**step)) + 1e-8)
    return net


def evenly(n: int, most: int) -> np.ndarray:
    """``most`` of n places, spread evenly over them; all of them if there are no more."""
    m = min(n, most)
    return (2 * np.arange(m) + 1) * n // (2 * max(m, 1))


def shares(n: np.ndarray, most: int) -> np.ndarray:
    """Passages to take of texts of n passages, ``most`` in all: the longest are cut to one length, and none is left out while there is one for each."""
    lo, hi = 1, max(int(n.max(initial=1)), 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if np.minimum(n, mid).sum() <= most else (lo, mid - 1)
    return np.minimum(n, lo) * (np.arange(len(n)) < most)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, fold: int = 1, sample: int = SAMPLE, sample_passages: int = SAMPLE_PASSAGES, text_passages: int = TEXT_PASSAGES) -> Network | None:
    """The network fitted on at most ``sample`` texts of each label, those whose ids have the least hashes.

    None if only one label is there. Each label has half of ``sample_passages``; of a text
    that is too long for its share, passages spread evenly over it are taken.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    ids = known.select(F.col(id_col).alias("_id"), "_y", F.xxhash64(id_col).alias("_h"))
    chosen = least_of_each(ids, "_y", sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_h", "_y", "_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(3)):
                x, base = passages(data, off)
                bags = [x[base[i] + evenly(base[i + 1] - base[i], text_passages)].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(3)), pa.array(bags, pa.binary())], names=["id", "h", "y", "bag"])

    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    # one row for each id leaves Spark, so at most 2 * sample bags of text_passages passages reach the driver
    bags_of = texts.mapInArrow(encode, f"id {kind}, h long, y int, bag binary").groupBy("id", "h", "y").agg(F.min("bag").alias("bag"))
    got = bags_of.toPandas().sort_values(["h", "id"])
    n = got["bag"].map(len).to_numpy() // (4 * FEATURES)
    y = got["y"].to_numpy(dtype=np.float64)
    if len(set(y)) < 2:
        return None
    take = np.zeros(len(n), np.int64)
    for label in (0, 1):
        take[y == label] = shares(n[y == label], max(sample_passages // 2, 1))
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES)[evenly(k, t)] for b, k, t in zip(got["bag"], n, take, strict=True) if t]
    return fit(np.concatenate(bags).astype(np.float64), np.concatenate([[0], np.cumsum(take[take > 0])]), y[take > 0])


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1) -> DataFrame:
    """id, held_out, score, predicted."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "held_out", "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(net, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=names)

    given = bounded_batches(docs).select(F.col(id_col), held_out(id_col, folds, fold).alias("_held"), F.col(text_col).cast("string").alias("_text"))
    return given.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, net: Network | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score ``least`` or more, with their columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(net, batch.column(at)) >= least))

    return bounded_batches(docs).mapInArrow(run, ddl(docs))


def _scores(net: Network | None, texts: pa.Array) -> np.ndarray:
    p = np.full(len(texts), 0.5)
    for lo, hi, data, off in slices(texts) if net else ():
        p[lo:hi] = net.score(*passages(data, off))
    return p
