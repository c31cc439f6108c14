"""Where releases come from: members of zip files, and the monthly release's address."""

from __future__ import annotations

import codecs
import datetime as dt
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from tideline.session import cut, is_local, scratch_path

MONTHS = "january february march april may june july august september october november december".split()
#: Bytes of a member unpacked at once.
PIECE = 1 << 20


def members(spark: SparkSession, path: str, names: list[str]) -> dict[str, str]:
    """Paths of the unpacked members in the shared folder, found by name in any case and any folder; raises with the names that there are.

    The driver reads the archive's directory alone. Tasks unpack the members, a piece at a time, each to a
    file of its own; what the committed attempts return is read. Read the lines by :func:`tilde.numbered_lines`.
    """
    if "://" not in path and not path.startswith("file:") and not is_local(spark):
        raise ValueError("an archive's address needs a scheme, as tasks on other machines open it too")
    with _opened(path) as z:
        there = {n.rpartition("/")[2].lower(): n for n in z.namelist()}
    missing = [n for n in names if n.lower() not in there]
    if missing:
        raise ValueError(f"no {', '.join(missing)} in the archive, which has {', '.join(there.values())}")
    folder = scratch_path(spark, "archive")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = f"{uuid.uuid4().hex}.txt"
                with _opened(path) as z, z.open(member) as source, fs.open_output_stream(f"{root}/{file}") as sink:
                    piece = source.read(PIECE).removeprefix(codecs.BOM_UTF8)
                    while piece:
                        sink.write(piece)
                        piece = source.read(PIECE)
                yield pa.RecordBatch.from_pydict({"name": [name], "file": [file]})

    wanted = spark.createDataFrame([(n, there[n.lower()]) for n in names], "name string, member string").repartition(len(names), "name")
    return {r["name"]: f"{folder}/{r['file']}" for r in cut(wanted.mapInArrow(unpack, "name string, file string")).collect()}


def _opened(path: str) -> zipfile.ZipFile:
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return zipfile.ZipFile(fs.open_input_file(root))


def monthly_addresses(base: str, as_of: dt.date) -> list[str]:
    """This month's release and the one before, to be tried in this order."""
    before = as_of.replace(day=1) - dt.timedelta(days=1)
    return [f"{base.rstrip('/')}/{d.year}/{MONTHS[d.month - 1]}" for d in (as_of, before)]


def is_apology(body: str) -> bool:
    """A page that a firewall sends in place of the release."""
    head = body[:2000].lower()
    return head.lstrip().startswith(("<!doctype html", "<html")) and ("apolog" in head or "access denied" in head)


