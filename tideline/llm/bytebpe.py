"""Byte-level BPE by a global shuffle of distinct words.

Texts are exploded to their pre-tokens, the matches of a pattern, with their
positions. A block of texts (BLOCK_BYTES of them, or one longer text) keeps the numbers of
its distinct words by position. The words themselves go to buckets by their hash, as one row for each
block and bucket: so all places of a word in the whole table meet in one
task, which encodes it once, and a word is never more rows than there are blocks,
however frequent it is. The ids are joined back to the blocks and put together by position.
Decoding is the same the other way: a block's distinct ids meet the table of tokens' bytes.

The rows of the texts are written once, with the number of their task and of
their block in it, so tasks that are run again later never number them anew. Only the
words are in the first exchange, and only ids and positions in the second; both are packed, as
they are many and short. The table of tokens is broadcast if its bytes are
at most TABLE_BYTES; if not, the distinct ids are dealt out to it and back.

Defined cases
- null texts are empty: no ids. Null ids are kept; repeated ids and texts are rows of their own.
- a text of any length is one row of a block; one word of any length is merged by
  a heap, in some 40 bytes of memory for each of its bytes.
- other columns are not read. Empty input: no rows.
- decoding: null ids, and null arrays, decode to no bytes; an id that no token has raises.
- bytes that are no UTF-8 do not occur in texts; decoded tokens are bytes, since ids may be cut anywhere.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import bounded_batches, written

#: Characters of texts of a block; items that are numbered, or put together, at once.
BLOCK_BYTES, RUN = 14 << 20, 1 << 16
#: Ids of a block that is decoded.
IDS = 1 << 18
#: Words of more bytes are merged by a heap.
SHORT = 200
#: Bytes of words that a task remembers at once.
REMEMBERED = 64 << 20
#: Bytes of tokens up to which their table is broadcast.
TABLE_BYTES = 32 << 20
NONE = 1 << 62


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks by tokens: a token in base64, a space and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines.split(b"\n")))}


class Merges:
    """The ids of a word: the adjacent pair of the least rank merges first, the leftmost of equals."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.rank = ranks
        self.longest = max(map(len, ranks), default=0)

    def encode(self, word: bytes) -> list[int]:
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        parts = self.short(word) if len(word) <= SHORT else self.long(word)
        try:
            return [self.rank[p] for p in parts]
        except KeyError as e:
            raise ValueError(f"the ranks have no token for the byte {e.args[0]!r}") from None

    def short(self, word: bytes) -> list[bytes]:
        """A plain list of the pairs' ranks, in which the least is looked for."""
        rank = self.rank
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = [rank.get(a + b, NONE) for a, b in itertools.pairwise(parts)]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            merged = parts[i] + parts.pop(i + 1)
            parts[i] = merged
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(merged + parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + merged, NONE)
        return parts

    def long(self, word: bytes) -> list[bytes]:
        """A heap of pairs by rank and place, over parts that know where the next and the last one begin."""
        n, most, get = len(word), self.longest, self.rank.get
        after, before, gone = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), bytearray(n + 1)
        todo = [r << 40 | i for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(todo)
        while todo:
            top = heapq.heappop(todo)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if gone[i] or j >= n:
                continue
            k = after[j]
            if k - i > most or get(word[i:k]) != top >> 40:
                continue  # one of the two has merged with another since
            gone[j] = 1
            after[i] = k
            if k < n:
                before[k] = i
                if (r := get(word[i : after[k]]) if after[k] - i <= most else None) is not None:
                    heapq.heappush(todo, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := get(word[h:k]) if k - h <= most else None) is not None:
                heapq.heappush(todo, r << 40 | h)
        return [word[i : after[i]] for i in range(n) if not gone[i]]


@functools.lru_cache(maxsize=2)
def _merges(lines: bytes) -> Merges:
    return Merges(read_ranks(lines))


def _ranges(kind: str) -> str:
    """The characters below U+10000 that a class like ``\\p{L}`` holds, as ranges for a set of the plain engine."""
    held = regex.compile(kind)
    there = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and held.match(chr(c))]
    begins = [c for c, before in zip(there, [-2, *there], strict=False) if c != before + 1]
    ends = [c for c, after in zip(there, [*there[1:], -2], strict=False) if c + 1 != after]
    return "".join(f"\\u{a:04x}-\\u{z:04x}" for a, z in zip(begins, ends, strict=True))


@functools.lru_cache(maxsize=8)
def splitter(pattern: str) -> Callable[[str], Iterable[str]]:
    """A function from a text to the matches of a pattern.

    Python's own engine is faster. It knows no classes like ``\\p{L}``, so they are written out for it; texts with
    characters from U+10000 on go to the other engine. Matches of a long text come one by one.
    """
    full = regex.compile(pattern)
    try:
        parts = regex.split(r"(\[(?:\\.|[^\]\\])*\])", pattern)  # sets at odd places
        written_out = lambda part, form: regex.sub(r"\\[pP]\{\w+\}|\\s", lambda m: form.format(_ranges(m[0])), part)
        plain = "".join(written_out(p, "{}") if k % 2 else written_out(p.replace(r"\S", f"[^{_ranges(chr(92) + 's')}]"), "[{}]") for k, p in enumerate(parts))
        quick = re.compile(plain)
    except re.error:
        quick = full

    def split(text: str) -> Iterable[str]:
        found = quick if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else full
        return found.findall(text) if len(text) < 1 << 20 else (m.group() for m in found.finditer(text))

    return split


# --- blocks: what is at which position -------------------------------------------------------------


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, their first bytes first, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


#: Numbers of one byte, of two, and of three: where each begins, and the first byte that says so.
ONE, TWO, THREE = (0, 0), (0xC0, 0xC0), (0xC0 + (0x30 << 8), 0xF0)


#: Numbers that are packed at once.
PART = 1 << 18


def packed_ranks(numbers: np.ndarray) -> bytes:
    """Numbers of which the small ones are frequent, in one to three bytes: first, second and third bytes apart, compressed, in parts."""
    if numbers.max(initial=0) >= THREE[0] + (0x10 << 16):
        return b"p" + packed(numbers)
    out = [b"r"]
    for lo in range(0, len(numbers), PART):
        n = numbers[lo : lo + PART].astype(np.int32)
        two, three = n - TWO[0], n - THREE[0]
        first = np.where(three >= 0, THREE[1] + (three >> 16), np.where(two >= 0, TWO[1] + (two >> 8), n)).astype(np.uint8)
        second = np.where(three >= 0, three >> 8, two)[two >= 0].astype(np.uint8)
        streams = [zstandard.compress(x.tobytes()) for x in (first, second, three[three >= 0].astype(np.uint8))]
        out += [struct.pack("<III", *map(len, streams)), *streams]
    return b"".join(out)


def unpacked_ranks(data: bytes) -> np.ndarray:
    if data[:1] == b"p":
        return unpacked(data[1:])
    parts, at = [np.zeros(0, np.uint32)], 1
    while at < len(data):
        sizes = struct.unpack_from("<III", data, at)
        ends = [at + 12 + sum(sizes[:k]) for k in range(4)]
        first, second, third = (np.frombuffer(zstandard.decompress(data[a:z]), np.uint8).astype(np.int32) for a, z in itertools.pairwise(ends))
        out = first.copy()
        more, most = np.flatnonzero(first >= TWO[1]), first >= THREE[1]
        out[more] = TWO[0] + (first[more] - TWO[1] << 8) + second
        out[most] = THREE[0] + (first[most] - THREE[1] << 16) + (second[most[more]] << 8) + third
        parts.append(out.astype(np.uint32))
        at = ends[3]
    return np.concatenate(parts)


def packed_positions(numbers: np.ndarray, often: int) -> bytes:
    """Numbers of which those from ``often`` on occur once, in their order: these need not be told, only that one stands there."""
    return struct.pack("<I", often) + packed_ranks(np.where(numbers >= often, np.uint32(0), numbers + np.uint32(1)))


def unpacked_positions(data: bytes) -> np.ndarray:
    numbers = unpacked_ranks(data[4:])
    once = numbers == 0
    numbers -= 1
    numbers[once] = struct.unpack_from("<I", data)[0] + np.arange(int(once.sum()), dtype=np.uint32)
    return numbers


def packed_words(words: list[bytes]) -> tuple[bytes, bytes]:
    """The sizes of words, and the words one after the other, compressed."""
    return packed(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.compress(b"".join(words))


def unpacked_words(sizes: bytes, data: bytes) -> list[bytes]:
    return _cut(zstandard.decompress(data), unpacked(sizes))


def _cut(whole: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [whole[a:z] for a, z in zip([0, *ends], ends, strict=False)]


class _Numbers(dict):
    """A number for each key, in the order in which they are met."""

    def __missing__(self, key: object) -> int:
        self[key] = n = len(self)
        return n


class _Block:
    """Rows' ids, and their items as numbers of distinct keys by position."""

    def __init__(self) -> None:
        self.numbers, self.at, self.ids, self.ends, self.size = _Numbers(), array("I"), [], [], 0

    def add(self, id_: pa.Scalar, size: int, items: Iterable) -> None:
        """A row's items; in runs, so that a long row's are never all in memory as objects."""
        items, number = iter(items), self.numbers.__getitem__
        while run := list(itertools.islice(items, RUN)):
            self.at.extend(map(number, run))
        self.ids.append(id_)
        self.ends.append(len(self.at))
        self.size += size

    def rows(self, block: int, buckets: int) -> tuple[dict[str, list], dict[str, list]]:
        """The row of the block, and those of its words by bucket; words are numbered by how often they occur, the most frequent first and those of equal number by their first place."""
        at = np.frombuffer(self.at, np.uint32) if self.at else np.zeros(0, np.uint32)
        frequent = np.argsort(-np.bincount(at, minlength=len(self.numbers)).astype(np.int32), kind="stable")
        rank = np.empty(len(frequent), np.uint32)
        rank[frequent] = np.arange(len(frequent), dtype=np.uint32)
        own = {"_block": [block], "_ids": [self.ids], "_ends": [packed(np.array(self.ends, np.uint32))], "_at": [packed_positions(rank[at], int((np.bincount(at, minlength=len(rank)) > 1).sum()))]}
        del at
        self.at = array("I")
        words = [w.encode() for w in self.numbers]
        self.numbers = _Numbers()
        members: dict[int, list[int]] = {}
        for i in frequent.tolist():
            members.setdefault(zlib.crc32(words[i]) % buckets, []).append(i)
        packs = [packed_words([words[i] for i in m]) for m in members.values()]
        steps = [packed(np.diff(rank[m].astype(np.int64), prepend=0)) for m in members.values()]
        return own, {"_block": [block] * len(members), "_bucket": list(members), "_steps": steps, "_sizes": [a for a, _ in packs], "_data": [z for _, z in packs]}


def _blocks(batches: Iterator[pa.RecordBatch], items: Callable[[str], Iterable], most: int) -> Iterator[tuple[int, _Block]]:
    """The blocks of rows (_id, _value), with their numbers: the task's, and their own in it."""
    number, held = TaskContext.get().partitionId() << 33, _Block()
    for batch in batches:
        for id_, value in zip(batch.column(0), batch.column(1), strict=True):
            value = value.as_py()
            held.add(id_, len(value or ""), items(value) if value else ())
            if held.size >= most:
                yield number, held
                number, held = number + 1, _Block()
    if held.ids:
        yield number, held


def _rows(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the columns that are given; all others are null."""
    n = len(columns["_block"])
    of = lambda f: columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
    return pa.RecordBatch.from_arrays([of(f) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _put_together(block: pa.Table, at: np.ndarray, pieces: list[bytes | None]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """The ids of a block's rows and, for each, its pieces one after the other; in runs of rows of some RUN positions."""
    if len(at) and (at.max() >= len(pieces) or None in pieces):
        raise ValueError("an id has no token")
    ends = np.concatenate([[0], unpacked(block["_ends"][0].as_py())]).astype(np.int64)
    ids, lo = block["_ids"].combine_chunks().flatten(), 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + RUN, "right")) - 1)
        hi = min(hi, len(ids))
        yield ids.slice(lo, hi - lo), [b"".join(map(pieces.__getitem__, at[a:z].tolist())) for a, z in itertools.pairwise(ends[lo : hi + 1].tolist())]
        lo = hi


# --- encoding -----------------------------------------------------------------------------------


def exploded(docs: DataFrame, pattern: str, id_col: str, text_col: str, buckets: int, block: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block (_block, _ids, _ends, _at) and one for each block and bucket of words (_block, _bucket, _steps, _sizes, _data).

    ``_steps`` are the differences of the words' numbers in the block.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("_block", pa.int64()), ("_bucket", pa.int32()), *[(c, pa.binary()) for c in ("_steps", "_sizes", "_data", "_ends", "_at")], ("_ids", pa.list_(first.column(0).type))])
        for number, held in _blocks(itertools.chain([first], batches), splitter(pattern), block):
            for rows in held.rows(number, buckets):
                yield _rows(rows, schema)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_value"))
    return bounded_batches(rows).mapInArrow(run, f"_block long, _bucket int, _steps binary, _sizes binary, _data binary, _ends binary, _at binary, _ids array<{kind}>")


def encoded_words(words: DataFrame, lines: bytes, parts: int) -> DataFrame:
    """(_block, _bucket, _sizes, _data): in place of the words the numbers of their ids, and their ids.

    A bucket is one task's, so a word is encoded once wherever it occurs, unless the words of a task
    are more than REMEMBERED; then the oldest half is forgotten.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(lines)
        known: dict[bytes, list[int]] = {}
        older: dict[bytes, list[int]] = {}
        held = 0
        for batch in batches:
            sizes, data = [], []
            for a, z in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                pieces = []
                for w in unpacked_words(a, z):
                    ids = known.get(w)
                    if ids is None:
                        ids = older.get(w)
                        if ids is None:
                            ids = merges.encode(w)
                        known[w] = ids
                        held += len(w) + 8 * len(ids) + 200
                        if held > REMEMBERED // 2:
                            known, older, held = {}, known, 0
                    pieces.append(ids)
                sizes.append(packed(np.fromiter(map(len, pieces), np.uint32, len(pieces))))
                data.append(packed(np.fromiter(itertools.chain.from_iterable(pieces), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.binary()), pa.array(data, pa.binary())], names=["_block", "_bucket", "_sizes", "_data"])

    dealt = words.repartition(parts, "_bucket")  # few bytes and much work, so not to be coalesced
    return bounded_batches(dealt).mapInArrow(run, "_block long, _bucket int, _sizes binary, _data binary")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, block: int = BLOCK_BYTES) -> DataFrame:
    """The id, n_tokens, ids and, as asked for, ids_sha256 (of the ids as little-endian unsigned 32-bit integers).

    ``ranks_path`` is read on the driver; its bytes, which a vocabulary bounds, go with the tasks.
    """
    with open(ranks_path, "rb") as f:
        lines = f.read()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(exploded(docs, pattern, id_col, text_col, parts, block), "bpe-words")
    words = encoded_words(rows.filter(F.col("_bucket").isNotNull()).select("_block", "_bucket", "_sizes", "_data"), lines, parts)
    met = rows.select("_block", "_bucket", "_steps", "_ends", "_at", "_ids").unionByName(words, allowMissingColumns=True)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids", *["ids_sha256"] * digests]

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        block = group.filter(pc.is_valid(group["_at"]))
        places, words = (group.filter(pc.is_valid(group[c])) for c in ("_steps", "_data"))
        steps = dict(zip(places["_bucket"].to_pylist(), places["_steps"].to_pylist(), strict=True))
        pieces: list[bytes | None] = [None] * sum(len(unpacked(s)) for s in words["_sizes"].to_pylist())
        for bucket, sizes, data in zip(*(words[c].to_pylist() for c in ("_bucket", "_sizes", "_data")), strict=True):
            for i, piece in zip(np.cumsum(unpacked(steps[bucket])).tolist(), _cut(unpacked(data).tobytes(), 4 * unpacked(sizes).astype(np.int64)), strict=True):
                pieces[i] = piece
        del group, places, words, steps
        for ids, blobs in _put_together(block, unpacked_positions(block["_at"][0].as_py()), pieces):
            off = np.cumsum([0, *[len(b) // 4 for b in blobs]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.Array.from_buffers(pa.int32(), int(off[-1]), [None, pa.py_buffer(b"".join(blobs))]))
            columns = [ids, pa.array(np.diff(off), pa.int64()), lists]
            if digests:
                columns.append(pa.array([hashlib.sha256(b).hexdigest() for b in blobs], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.groupBy("_block").applyInArrow(finished, f"`{id_col}` {kind}, n_tokens long, ids array<int>" + ", ids_sha256 string" * digests)


# --- decoding -----------------------------------------------------------------------------------


def token_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """(_key, _piece): the bytes of every token by its id."""
    return spark.createDataFrame([(r, bytearray(t)) for t, r in ranks.items()], "_key long, _piece binary")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = (), table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The id, the columns to keep, and ``decoded``, the bytes of the ids' tokens."""
    with open(ranks_path, "rb") as f:
        ranks = read_ranks(f.read())
    held = [id_col, *keep]
    own = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(held)])
    source = encoded.select(own.alias("_id"), F.col(ids_col).alias("_value"))
    kind = source.schema["_id"].dataType.simpleString()
    table = token_table(encoded.sparkSession, ranks)
    schema = f"_id {kind}, decoded binary"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block, of IDS ids or one longer row, with the number of its rows, and one for each of its distinct ids."""
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            block = (np.cumsum(size) - 1) // IDS
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(batch)]
            for lo, hi in itertools.pairwise(cuts):
                lists = batch.column(1).slice(lo, hi - lo)
                there = pc.is_valid(flat := lists.flatten()).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(there)])[np.cumsum(size[lo:hi])]
                keys, at = np.unique(flat.drop_null().to_numpy(), return_inverse=True)
                ids = batch.column(0).slice(lo, hi - lo)
                shape = pa.schema([("_block", pa.int64()), ("_rows", pa.int64()), ("_key", pa.int64()), ("_number", pa.int64()), ("_ends", pa.binary()), ("_at", pa.binary()), ("_ids", pa.list_(ids.type))])
                whole = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids)
                yield _rows({"_block": [number], "_rows": [len(keys) + 1], "_ends": [packed(ends)], "_at": [packed(at)], "_ids": whole}, shape)
                yield _rows({"_block": np.full(len(keys), number), "_rows": np.full(len(keys), len(keys) + 1), "_key": keys.astype(np.int64), "_number": np.arange(len(keys))}, shape)
                number += 1

    rows = bounded_batches(source).mapInArrow(explode, f"_block long, _rows long, _key long, _number long, _ends binary, _at binary, _ids array<{kind}>")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        is_block = pc.is_valid(group["_at"])
        keys = group.filter(pc.invert(is_block)).sort_by("_number")
        block = group.filter(is_block)
        for ids, blobs in _put_together(block, unpacked(block["_at"][0].as_py()), keys["_piece"].to_pylist()):
            yield pa.RecordBatch.from_arrays([ids, pa.array(blobs, pa.binary())], names=["_id", "decoded"])

    if sum(len(t) + 64 for t in ranks) <= table_bytes:
        # nothing is dealt out: a task's blocks meet the table and are put together where they are
        met = rows.join(F.broadcast(table), "_key", "left").select("_block", "_rows", "_number", "_piece", "_ends", "_at", "_ids")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, list[pa.RecordBatch]] = {}
            for batch in batches:
                for block in batch.column(0).unique().to_pylist():
                    mine = batch.filter(pc.equal(batch.column(0), block))
                    there = parts.setdefault(block, [])
                    there.append(mine)
                    if sum(map(len, there)) == mine.column(1)[0].as_py():
                        yield from finished(iter(parts.pop(block)))
            if parts:
                raise ValueError("a block lacks rows")

        out = met.mapInArrow(run, schema)
    else:
        # a block has an id once, so no id is more rows than there are blocks
        met = written(rows, "bpe-ids").join(table, "_key", "left").select("_block", "_number", "_piece", "_ends", "_at", "_ids")
        out = met.groupBy("_block").applyInArrow(finished, schema)
    return out.select(*[F.col(f"_id.c{i}").alias(c) for i, c in enumerate(held)], "decoded")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    encoded = encode(docs, ranks_path, pattern, id_col, text_col, digests=True)
    back = decode(encoded, ranks_path, id_col, keep=("n_tokens", "ids_sha256"))
    return back.select(id_col, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
