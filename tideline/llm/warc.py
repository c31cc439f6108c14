"""WARC archives with a two-level capture index.

Writing: tasks write gzipped WARC records to archives in a shared folder, one
file per task attempt under a name of its own, and return where each record
stands. What the committed attempts returned is the manifest; files of lost
attempts are in no manifest and so are never read.

Index: captures are sorted by URL key (the host's labels reversed, then the
path) and page id over ranges of the keys. Each range becomes one file of
compressed blocks; the sparse directory has the first key of each block.

Reading: a capture's key is searched among the ranges' first keys, in its
range's directory, and in the one block that can hold it, which is read by its
byte range; then the record's own byte range is read from its archive.

Defined cases
- null html: empty payload, written like any other. Null url: no target header, the empty key.
- equal payloads of ``least`` bytes or more: that of the largest page id is the response and
  the others revisit it; rows that tie in page id are all responses. Smaller payloads: all responses.
- null page ids: revisits where some equal payload has an id, else responses.
- repeated rows: one record each, and each is found again.
- empty input: no archives, no index, no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import bounded_batches, cut, discard, join_hot, scratch_path, written

#: Captures in a block of the index; in a range of it, roughly and at most; bytes of an archive; bytes of one range read.
BLOCK, RANGE, ARCHIVE_BYTES, READ_BYTES = 512, 200_000, 1 << 30, 4 << 20
#: zlib's level for records.
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PLACES = "key string, page_id {kind}, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """The host's labels in reverse, ")", and the rest of the url; empty for null."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[^:/?#]*://[^/?#]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _named(page_id: object, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(page_id: object, url: str | None, payload: bytes, original: object = None, original_url: str | None = None, revisit: bool = False) -> bytes:
    """One WARC record, not compressed. A revisit holds the HTTP head alone."""
    safe = url and "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_named(page_id, url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if safe:
        head.append(f"WARC-Target-URI: {safe}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_named(original, original_url)}", f"X-Refers-To-Page: {original}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises if its parts don't fit its lengths."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields.get("Content-Length", -1))
    if not found or first != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"no whole WARC record: {raw[:60]!r}")
    return fields, rest[:n]


def _revisits(keys: DataFrame) -> DataFrame:
    """(_again_id, _again_sha, _top_id, _top_url): every page id and digest that is a revisit, and the response that it is one of.

    ``keys``: _id, _url, _sha. No payloads move.
    """
    groups = keys.groupBy("_sha").agg(F.max(F.struct("_id", "_url")).alias("_top"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    groups = cut(groups.select("_sha", F.col("_top._id").alias("_top_id"), F.col("_top._url").alias("_top_url"), "_n"))
    met = join_hot(keys.select("_id", "_sha"), groups, "_sha", "_n")
    again = met.filter(F.col("_top_id").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_top_id")))
    return again.select(F.col("_id").alias("_again_id"), F.col("_sha").alias("_again_sha"), "_top_id", "_top_url").dropDuplicates(["_again_id", "_again_sha"])


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row under ``folder``; the manifest, written to Parquet: key, page_id, file, offset, length."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    keys = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.sha1(payload).alias("_sha"), (F.octet_length(payload) >= least).alias("_large"))
    again = written(_revisits(cut(keys.filter("_large").drop("_large"))), "warc-revisits")
    # payloads are joined by page id and digest, so that no digest's copies are one key
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"), F.sha1(payload).alias("_sha"))
    met = rows["_id"].eqNullSafe(again["_again_id"]) & (rows["_sha"] == again["_again_sha"])
    told = rows.join(again, met, "left").select("_id", "_url", "_payload", url_key(F.col("_url")).alias("_key"), "_top_id", "_top_url", F.col("_again_sha").isNotNull().alias("_again"))
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            places = []
            light = zip(*(batch.column(c).to_pylist() for c in (0, 1, 4, 5, 6)), strict=True)
            for i, (pid, url, top, top_url, again) in enumerate(light):
                body = batch.column(2)[i].as_py()  # one payload at a time
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = z.compress(record(pid, url, body, top, top_url, again)) + z.flush()
                out.write(raw)
                places.append((name, at, len(raw)))
                at += len(raw)
            if places:
                yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), *map(pa.array, zip(*places, strict=True))], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    kind = pages.schema[id_col].dataType.simpleString()
    bounded_batches(told)
    return written(told.mapInArrow(run, _PLACES.format(kind=kind)), "warc-manifest")


def build_index(manifest: DataFrame, folder: str, block: int = BLOCK, per_range: int = RANGE) -> DataFrame:
    """Sort the captures into files of compressed blocks; the directory, written to Parquet.

    Directory: range, block, file, offset, length, first_key, first_id, captures.
    """
    spark = manifest.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-manifest.count() // per_range))
    order = ["key", "page_id", "file", "offset"]
    kind = manifest.schema["page_id"].dataType.simpleString()
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        rows, held, n, at, out, name = [], [], 0, 0, None, ""

        def close_block() -> None:
            nonlocal at, n, out, name
            if out is None:
                name = f"{uuid.uuid4().hex}.idx"
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).slice(0, block)
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            raw = zlib.compress(sink.getvalue().to_pybytes(), 6)
            out.write(raw)
            rows.append((table.column("part")[0].as_py(), len(rows), name, at, len(raw), table.column("key")[0].as_py(), table.column("page_id")[0].as_py(), table.num_rows))
            at += len(raw)

        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                piece = batch.slice(lo, block)
                held.append(piece)
                n += piece.num_rows
                while n >= block:
                    close_block()
                    rest = pa.Table.from_batches(held).slice(block).to_batches()
                    held, n = rest, n - block
        if n:
            close_block()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(k, t) for k, t in zip(names, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), batch_kind[0], pa.int64()], strict=True)]))

    names = ["part", "block", "file", "offset", "length", "first_key", "first_id", "captures"]
    from pyspark.sql.pandas.types import to_arrow_type

    batch_kind = [to_arrow_type(manifest.schema["page_id"].dataType)]
    ranged = manifest.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), *order, "length")
    return written(ranged.mapInArrow(run, f"part int, block int, file string, offset long, length long, first_key string, first_id {kind}, captures long"), "warc-directory")


def _at(keys: list, key: tuple) -> int:
    return max(0, bisect.bisect_left(keys, key) - 1)


def _order(key: str, page_id: object) -> tuple:
    """Spark's order: UTF-8 bytes of the key, then the id with null first."""
    return (key.encode(), page_id is not None, page_id if page_id is not None else 0)


def look_up(captures: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """(key, page_id, file, offset, length) of every capture asked for by key and page id.

    Rows of ``captures`` that repeat are asked for once. The first keys of the ranges go to
    the tasks; their number is the index's number of ranges. A key may begin in one range
    and go on in the next ones, as may a block's: all that can hold it are read.
    """
    tops = sorted((_order(r["k"]["first_key"], r["k"]["first_id"]), r["part"]) for r in directory.groupBy("part").agg(F.min(F.struct("first_key", "first_id")).alias("k")).collect())
    kind = directory.schema["first_id"].dataType.simpleString()
    firsts, parts = [t[0] for t in tops], [t[1] for t in tops]

    def route(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            take, part = [], []
            for i, (k, p) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                want = _order(k, p)
                lo, hi = _at(firsts, want), bisect.bisect_right(firsts, want)
                take += [i] * (max(hi, lo + 1) - lo)
                part += parts[lo : max(hi, lo + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0).take(pa.array(take, pa.int64())), b.column(1).take(pa.array(take, pa.int64()))], names=["part", "key", "page_id"])

    if not parts:
        return captures.sparkSession.createDataFrame([], _PLACES.format(kind=kind))
    asked = captures.select(F.coalesce("key", F.lit("")).alias("key"), "page_id").distinct()
    asked = asked.mapInArrow(route, f"part int, key string, page_id {kind}")

    def find(_: tuple, blocks: pa.Table, wanted: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(folder)
        blocks = blocks.sort_by("block").to_pylist()
        heads = [_order(b["first_key"], b["first_id"]) for b in blocks]
        by_block: dict[int, list[tuple]] = {}
        for k, p in zip(wanted.column("key").to_pylist(), wanted.column("page_id").to_pylist(), strict=True):
            want = _order(k, p)
            lo = _at(heads, want) if heads else 0
            for i in range(lo, max(bisect.bisect_right(heads, want), lo + 1) if heads else 0):
                by_block.setdefault(i, []).append(want)
        got: list[pa.Table] = []
        for i, wants in sorted(by_block.items()):
            b = blocks[i]
            with fs.open_input_file(f"{root}/{b['file']}") as f:
                raw = f.read_at(b["length"], b["offset"])
            lines = pa.ipc.open_stream(zlib.decompress(raw)).read_all()
            keys = [_order(k, p) for k, p in zip(lines.column("key").to_pylist(), lines.column("page_id").to_pylist(), strict=True)]
            take = [j for w in wants for j in range(bisect.bisect_left(keys, w), bisect.bisect_right(keys, w))]
            got.append(lines.take(pa.array(take, pa.int64())).select(["key", "page_id", "file", "offset", "length"]))
        return pa.concat_tables(got) if got else pa.schema(schema).empty_table()

    from pyspark.sql.pandas.types import to_arrow_type

    schema = [("key", pa.string()), ("page_id", to_arrow_type(directory.schema["first_id"].dataType)), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    return directory.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(find, _PLACES.format(kind=kind))


def read(places: DataFrame, folder: str, payload: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records at these places: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and the payload (of a revisit none).

    Places are sorted by archive and offset, so that neighbours come in one range read. The
    digest of every response is computed anew from its payload and must be its header's.
    """
    kind = places.schema["page_id"].dataType.simpleString()
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True))
            rows, i, total = [], 0, 0
            while i < len(where):
                j, (file, start, length) = i + 1, where[i]
                end = start + length
                while j < len(where) and where[j][0] == file and start <= where[j][1] <= end and where[j][1] + where[j][2] - start <= read_bytes:
                    end, j = max(end, where[j][1] + where[j][2]), j + 1
                with fs.open_input_file(f"{root}/{file}") as f:
                    raw = f.read_at(end - start, start)
                for _, at, n in where[i:j]:
                    fields, block = parsed(zlib.decompress(raw[at - start : at - start + n], 31))
                    body = block.partition(b"\r\n\r\n")[2]
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and digest(body) != said:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} has another digest than its header")
                    rows.append((fields.get("X-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], int(fields["X-Payload-Length"]), said, fields.get("X-Refers-To-Page"), body)[: len(names)])
                    total += len(body)
                if payload and total > 8 * read_bytes:
                    yield made(rows)
                    rows, total = [], 0
                i = j
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    ranged = places.select("page_id", "file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    out = ranged.mapInArrow(run, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload binary" * payload)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def resolved(records: DataFrame) -> DataFrame:
    """Records with their payloads, where revisits have that of the response that they refer to.

    A revisit without a response of its digest and length raises.
    """
    own = records.filter("record_type = 'response'")
    given = own.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("_p")).dropDuplicates(["refers_to", "payload_digest"])
    again = records.filter("record_type = 'revisit'").drop("payload").join(given, ["refers_to", "payload_digest"], "left")
    fits = F.octet_length("_p").eqNullSafe(F.col("payload_bytes").cast("int"))
    body = F.when(fits, F.col("_p")).otherwise(F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("page_id").cast("string"))).cast("binary"))
    return own.unionByName(again.withColumn("payload", body).select(*records.columns))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, payload: bool = False) -> DataFrame:
    """Write every row to archives, index them, and read every capture back by its key; with payloads, revisits are resolved.

    The index goes when all places are found; the archives stay, as what is returned reads them.
    """
    spark: SparkSession = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write(pages, f"{folder}/archives", id_col, url_col, html_col, least)
    directory = build_index(manifest, f"{folder}/index")
    captures = pages.select(url_key(F.col(url_col).cast("string")).alias("key"), F.col(id_col).alias("page_id"))
    places = written(look_up(captures, directory, f"{folder}/index"), "warc-places")  # else the sort by place would look them up twice
    discard(spark, f"{folder}/index")
    records = read(places, f"{folder}/archives", payload)
    return resolved(written(records, "warc-records")) if payload else records


def oracle_sql(least: int = 0) -> str:
    """What the round trip of `pages` must give, in DuckDB: digests in base32, and which record each revisits."""
    chars = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    group = "('0x' || substr(h, g * 5 + 1, 5))::INT"
    base32 = " || ".join(f"substr({chars}, ({group} >> {shift}) % 32 + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(body) AS n, h, array_to_string(list_transform(range(8), lambda g: {base32}), '') AS digest FROM p),
m AS (SELECT *, CASE WHEN n >= {least} THEN max(page_id) OVER (PARTITION BY h) END AS top FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM m
"""
