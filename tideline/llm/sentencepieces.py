"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised by the library and cut to units at places that no piece
of the vocabulary goes over; each unit is encoded by a score-ordered agenda of
adjacent symbol pairs. Units recur, so each Python worker keeps a bounded
memory of the short ones. In every Arrow batch all units that the agenda has
encoded anew are encoded by the sentencepiece library too, and so is one whole
text, over its units' borders; a difference raises: the vocabulary is then no
merge-type one. Decoding is the library's.

Defined cases
- null or empty text: no ids, decoded to the empty text.
- characters that no piece holds: their UTF-8 bytes' pieces, or the unknown id
  where the vocabulary has no byte pieces.
- texts of any length are encoded whole; the agenda's work is n log n in a unit.
- repeated rows: each is encoded. Empty input: no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
import string
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.textbytes import slices
from tideline.session import bounded_batches

#: Units that a worker remembers at most, roughly, and characters of one: some 50 MB. Those not met for longest go.
REMEMBERED, LONGEST = 200_000, 48
#: Texts between two checks against the library; characters up to which one is preferred to be checked whole.
CHECKED, MOST_WHOLE = 512, 20_000
#: Symbols up to which a plain list of pairs beats a heap; the rank of a pair that cannot merge.
SHORT, NONE = 48, 1 << 31

SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class Vocabulary:
    """The pieces of a model, ranked by score, and the encoder over them."""

    def __init__(self, model: bytes) -> None:
        sp = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = sorted({sp.get_score(i) for i in normal}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.rank = {sp.id_to_piece(i): place[sp.get_score(i)] for i in normal}
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.text_of = [str(i) for i in range(size)]
        # a unit is a run of spaces with what follows it, and a line feed is one by itself,
        # if no piece goes over such a cut
        pieces = [p for p in self.ids if len(p) > 1]
        alone = "" if any("\n" in p for p in pieces) else "\n"
        rest = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"
        # letters right before a mark are one too, for the marks that no piece has after a letter
        marks = "".join(m for m in string.punctuation if not any(re.search(f"[{LETTERS}]{re.escape(m)}", p) for p in pieces))
        if marks:
            rest = f"{SPACE}*[{LETTERS}]+(?=[{re.escape(marks)}])|{rest}"
        self.unit = re.compile(f"\n|{rest}" if alone else rest)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            self.unit = re.compile(r"[\s\S]+")
        self.lines_apart = bool(alone) and self.unit.pattern != r"[\s\S]+"
        self.known: dict[str, tuple[int, ...]] = {}  # units met lately, and those met before these
        self.older: dict[str, tuple[int, ...]] = {}
        self.fresh: list[tuple[str, tuple[int, ...]]] = []

    def agenda(self, unit: str) -> tuple[int, ...]:
        """The ids of a unit: the best-scored adjacent pair merges first, the leftmost of equals."""
        symbols = self.short(list(unit)) if len(unit) <= SHORT else self.long(list(unit))
        ids, out = self.ids, []
        for s in symbols:
            i = ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend([self.bytes[b] for b in s.encode()])
            else:
                out.append(self.unknown)
        return tuple(out)

    def short(self, symbols: list[str]) -> list[str]:
        """The agenda as a plain list of the pairs' ranks, in which the least is looked for."""
        rank = self.rank
        ranks = [rank.get(a + b, NONE) for a, b in itertools.pairwise(symbols)]
        while ranks:
            r = min(ranks)
            if r == NONE:
                break
            i = ranks.index(r)
            merged = symbols[i] + symbols[i + 1]
            symbols[i : i + 2] = [merged]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(merged + symbols[i + 1], NONE)
            if i:
                ranks[i - 1] = rank.get(symbols[i - 1] + merged, NONE)
        return symbols

    def long(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap, over a linked list of symbols."""
        rank = self.rank
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                todo.append(r << 32 | i)
        heapq.heapify(todo)
        while todo:
            top = heapq.heappop(todo)
            i = top & 0xFFFFFFFF
            j = after[i]
            if not symbols[i] or j >= n:
                continue
            merged = symbols[i] + symbols[j]
            if rank.get(merged) != top >> 32:
                continue  # one of the two has merged with another since
            symbols[i], symbols[j] = merged, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(merged + symbols[k])
                if r is not None:
                    heapq.heappush(todo, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank.get(symbols[h] + merged)
                if r is not None:
                    heapq.heappush(todo, r << 32 | h)
        return [x for x in symbols if x]

    def encode(self, text: str) -> list[int]:
        known = self.known
        out: list[int] = []
        for unit in self.unit.findall(self.library.normalize(text)) if text else ():
            ids = known.get(unit)
            if ids is None:
                ids = self.older.get(unit)
                if ids is None:
                    ids = self.agenda(unit)
                    self.fresh.append((unit, ids))
                if len(unit) <= LONGEST:
                    known[unit] = ids
            out += ids
        return out

    def check(self, text: str, ids: list[int]) -> None:
        """Encode the new units by the library as well, and a whole text."""
        plain, cut = [], []
        for u, _ in self.fresh:
            if not self.lines_apart or u.strip(SPACE) and u[0] == SPACE:
                plain.append(u[1:].replace(SPACE, " ") if u[0] == SPACE else u)
                cut.append(0)
            else:  # the library puts a space before it; a line feed keeps the two apart
                plain.append("\n" + u.replace(SPACE, " "))
                cut.append(2)
        for (u, own), k, said in zip(self.fresh, cut, self.library.encode(plain, num_threads=1), strict=True):
            if tuple(said[k:]) != own:
                raise ValueError(f"the agenda and the sentencepiece library differ on {u[:80]!r}")
        if self.library.encode(text) != ids:
            raise ValueError(f"the agenda and the sentencepiece library differ on a text that begins with {text[:80]!r}")
        self.fresh = []
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known


@functools.lru_cache(maxsize=2)
def _vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _encoded(v: Vocabulary, whole: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[list[int]]]]:
    """Parts of a batch, of CHECKED rows and SLICE_BYTES of text or so, and their texts' ids, checked. The text checked whole is a part's longest of MOST_WHOLE bytes at most, else its shortest."""
    for lo, hi, data, off in slices(whole.column(column)):
        raw = data.tobytes()
        for a in range(0, hi - lo, CHECKED):
            z = min(a + CHECKED, hi - lo)
            texts = [raw[off[i] : off[i + 1]].decode("utf-8", "replace") for i in range(a, z)]
            encoded = [v.encode(t) for t in texts]
            size = [len(t) for t in texts]
            k = max(range(z - a), key=lambda i: size[i] if size[i] <= MOST_WHOLE else -size[i])
            v.check(texts[k], encoded[k])
            yield whole.slice(lo + a, z - a), encoded


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True, digests: bool = False) -> DataFrame:
    """The id, n_tokens and, as asked for, ids, decoded, ids_sha256 and decoded_sha256.

    ``model_path`` is read on the driver; its bytes, which a vocabulary bounds, go with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long" + ", ids array<int>" * ids + ", decoded string" * decoded + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(model)
        for whole in batches:
            for batch, encoded in _encoded(v, whole, 1):
                columns = [batch.column(0), pa.array([len(x) for x in encoded], pa.int64())]
                back = v.library.decode(encoded) if (decoded or digests) and encoded else []
                if ids:
                    columns.append(pa.array(encoded, pa.list_(pa.int32())))
                if decoded:
                    columns.append(pa.array(back, pa.string()))
                if digests:
                    said = v.text_of
                    columns.append(pa.array([hashlib.sha256(",".join([said[i] for i in x]).encode()).hexdigest() for x in encoded]))
                    columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "n_tokens", *["ids"] * ids, *["decoded"] * decoded, *["ids_sha256", "decoded_sha256"] * digests]
    return bounded_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns of docs, the text replaced by what its ids decode to, and n_tokens."""
    with open(model_path, "rb") as f:
        model = f.read()
    names, at = [*docs.columns, "n_tokens"], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(model)
        for whole in batches:
            for batch, encoded in _encoded(v, whole, at):
                columns = list(batch.columns)
                columns[at] = pa.array(v.library.decode(encoded) if encoded else [], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in encoded], pa.int64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_tokens long"
    return bounded_batches(docs).mapInArrow(run, schema)
