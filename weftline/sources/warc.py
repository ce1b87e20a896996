"""WARC and WET files as DataFrames, by the Python data source API: one partition for each group of files.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").option("path", "/crawl/*.warc.gz").option("type", "response").load()

A file is read as a stream of its members; the type filter is applied before a payload is read. A damaged record ends its
file: with `on_error` "raise" it fails the job, with "report" it gives a row of the type `damaged` whose payload is the
message, with "skip" (the default) nothing. Paths are listed by the engine's file system, local or not; files outside
local folders are fetched through it in one piece.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "warc_type string, target_uri string, headers map<string,string>, payload binary, file string, pos bigint"


def _open(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


def http_body(block: bytes) -> bytes:
    """The body of an HTTP response; a block without HTTP head as it is."""
    if not block.startswith(b"HTTP/"):
        return block
    head, sep, body = block.partition(b"\r\n\r\n")
    return body if sep else b""


def records(stream, wanted: str | None = None) -> Iterator[tuple[str | None, str | None, dict[str, str], bytes]]:
    """(type, uri, headers, payload) of each record; those of other types than the wanted one are passed over unread."""
    while True:
        line = stream.readline()
        while line and not line.strip():
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) and line.strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip()] = v.strip()
        low = {k.lower(): v for k, v in headers.items()}
        size = int(low.get("content-length", 0))
        kind = low.get("warc-type")
        if wanted is not None and kind != wanted:
            while size > 0:
                n = len(stream.read(min(size, 1 << 20)))
                if not n:
                    raise EOFError("record cut off")
                size -= n
            continue
        block = stream.read(size)
        if len(block) < size:
            raise EOFError("record cut off")
        yield kind, low.get("warc-target-uri"), headers, http_body(block) if kind == "response" else block


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.type = options["path"], options.get("type")
        self.group, self.on_error = int(options.get("filespertask", 4)), options.get("on_error", "skip")

    def partitions(self):
        path = self.path
        files = sorted(glob.glob(os.path.join(path, "*.warc*")) if os.path.isdir(path) else glob.glob(path))
        return [_Files(files[i : i + self.group]) for i in range(0, len(files), self.group)]

    def read(self, partition):
        for name in partition.files:
            pos = -1
            try:
                with _open(name) as f:
                    for pos, (kind, uri, headers, payload) in enumerate(records(f, self.type)):
                        yield kind, uri, headers, payload, name, pos
            except (OSError, EOFError, ValueError, zlib.error) as e:
                if self.on_error == "raise":
                    raise
                if self.on_error == "report":
                    yield "damaged", None, {}, str(e).encode(), name, pos + 1


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, type: str | None = "response", files_per_task: int = 4, on_error: str = "skip") -> DataFrame:
    """Records of the files; type None for all of them. Paths with a scheme other than file: are listed and read by the engine
    (`read_warc_anywhere`)."""
    if "://" in path and not path.startswith("file:"):
        return read_warc_anywhere(spark, path, type, on_error)
    spark.dataSource.register(WarcDataSource)
    r = spark.read.format("warc").option("path", path.removeprefix("file://")).option("filespertask", files_per_task).option("on_error", on_error)
    return (r.option("type", type) if type else r).load()


def read_warc_anywhere(spark: SparkSession, path: str, type: str | None = "response", on_error: str = "skip") -> DataFrame:
    """The same through the engine's binary source, which lists any file system that it knows: one file a row, so that a file
    must fit a task's memory."""
    fields = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows, pos = [], -1
                try:
                    stream = io.BytesIO(content)
                    for pos, r in enumerate(records(gzip.GzipFile(fileobj=stream) if name.endswith(".gz") else stream, type)):
                        rows.append((*r, name, pos))
                except (OSError, EOFError, ValueError, zlib.error) as e:
                    if on_error == "raise":
                        raise
                    if on_error == "report":
                        rows.append(("damaged", None, {}, str(e).encode(), name, pos + 1))
                cols = list(zip(*rows)) or [()] * len(fields)
                kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if k == 2 else c, t) for k, (c, t) in enumerate(zip(cols, kinds))], fields)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def concat_warcs(paths: list[str], out: str, most: int = 64) -> tuple[int, int]:
    """The records of the first `most` files by name in one compressed file, each record a member of its own, so that it can
    be read from any of them on. Damaged files give what stands before the damage. Returns (records, damaged files). The
    output may lie in the folder of the inputs: it is not one of them."""
    n = damaged = 0
    with open(out + ".part", "wb") as f:
        for name in [p for p in sorted(paths) if os.path.abspath(p) != os.path.abspath(out)][:most]:
            try:
                with _open(name) as g:
                    for raw in raw_records(g):
                        f.write(gzip.compress(raw))
                        n += 1
            except (OSError, EOFError, ValueError, zlib.error):
                damaged += 1
    os.replace(out + ".part", out)
    return n, damaged


def raw_records(stream) -> Iterator[bytes]:
    """Records byte for byte."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head, size = [line], 0
        while (line := stream.readline()) and line.strip():
            head.append(line)
            if line.lower().startswith(b"content-length:"):
                size = int(line.split(b":", 1)[1])
        block = stream.read(size)
        if len(block) < size:
            raise EOFError("record cut off")
        yield b"".join(head) + b"\r\n" + block + b"\r\n\r\n"


def read_wet_text(spark: SparkSession, path: str) -> DataFrame:
    """(headers, text) of plain-text records. A record begins with a line that begins with WARC/1.0; the same letters inside
    a line are text. Of a repeated header the last value counts, as in a dictionary. Blank lines of a body vanish; lines
    are joined as they are and the whole is stripped."""
    # The separator is a newline before the mark: the first record of a file has none and loses its mark here.
    raw = spark.read.option("lineSep", "\nWARC/1.0").text(path).select(F.regexp_replace("value", r"^WARC/1\.0", "").alias("value")).filter(F.length(F.trim(F.regexp_replace("value", r"\s", ""))) > 0)
    lines = F.split(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\r?\n")
    x = raw.select(lines.alias("l"))
    at = F.array_position(F.transform("l", lambda s: F.trim(s)), "")
    head = F.when(at > 0, F.slice("l", F.lit(1), at.cast("int") - 1)).otherwise(F.col("l"))
    body = F.when(at > 0, F.expr("slice(l, cast(array_position(transform(l, s -> trim(s)), '') as int) + 1, size(l))")).otherwise(F.array().cast("array<string>"))
    pairs = F.transform(F.filter(head, lambda s: F.instr(s, ":") > 0), lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), F.trim(F.regexp_replace(s, r"^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    headers = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))
    text = F.array_join(F.transform(F.filter(body, lambda s: F.trim(s) != ""), lambda s: F.concat(s, F.lit("\n"))), "")
    return x.select(headers.alias("headers"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))
