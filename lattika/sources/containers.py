"""Scans of binary files into rows: container boxes, codestream markers, and plain image planes.

Files come from Spark's ``binaryFile`` reader, so any store that Spark reads will do. One file is one row; a malformed one gives one row with an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signature box, brands and marker codes.
SIGNATURE = bytes.fromhex("0000000C6A5020200D0A870A")
BRANDS = {"jpx ": "jpx", "jpm ": "jpm", "jph ": "jph", "jp2 ": "jp2"}
START, TILE_PART, DATA, END = 0xFF4F, 0xFF90, 0xFF93, 0xFFD9
#: Markers without a segment.
BARE = {START, DATA, END}
#: Markers with a segment that the scan of whole streams steps over.
SIZED = {0xFF51, 0xFF52, 0xFF53, 0xFF5C, 0xFF5D, 0xFF5E, 0xFF5F, 0xFF64, TILE_PART}
SEGMENTS = {0xFF50, 0xFF51, 0xFF52, 0xFF53, 0xFF55, 0xFF57, 0xFF58, 0xFF5C, 0xFF5D, 0xFF5E, 0xFF5F, 0xFF60, 0xFF61, 0xFF63, 0xFF64}


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length and content of files; the glob is applied by the reader."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def file_format(content: Column) -> Column:
    """j2k for a bare codestream, else the brand of a signed container (jp2 by default), else null."""
    head = lambda a, n: F.substring(content, a, n)
    brand = F.when(head(17, 4) == F.lit(b"ftyp"), F.decode(head(21, 4), "UTF-8"))
    kind = F.lit("jp2")
    for text, name in BRANDS.items():
        kind = F.when(brand == text, name).otherwise(kind)
    return F.when(head(1, 2) == F.lit(b"\xff\x4f"), "j2k").when(head(1, 12) == F.lit(SIGNATURE), kind)


def boxes_of(data: bytes) -> Iterator[tuple]:
    """(offset, header size, length, type, error) of the top-level boxes; length 0 runs to the end, 1 announces 8 bytes of length."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            yield at, None, None, None, "incomplete header"
            return
        length, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if length == 0:
            length = len(data) - at
        elif length == 1:
            if at + 16 > len(data):
                yield at, None, None, None, "incomplete extended header"
                return
            length, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        if length < head:
            yield at, None, None, None, f"invalid length {length}"
            return
        if at + length > len(data):
            yield at, None, None, None, "box extends past the end"
            return
        yield at, head, length, kind.decode("latin-1"), None
        at += length


def markers_of(data: bytes) -> Iterator[tuple]:
    """(position, marker, length of the segment, error) of a main header, up to the first tile part."""
    if data[:2] != b"\xff\x4f":
        yield 0, None, None, "no start marker"
        return
    yield 0, START, 0, None
    at = 2
    while at + 2 <= len(data):
        code = struct.unpack_from(">H", data, at)[0]
        if code == TILE_PART:
            yield at, code, 0, None
            return
        if code in BARE:
            yield at, code, 0, None
            at += 2
            continue
        if code not in SEGMENTS:
            yield at, code, None, "unknown marker"
            return
        length = struct.unpack_from(">H", data, at + 2)[0] if at + 4 <= len(data) else 0
        if length < 2 or at + 2 + length > len(data):
            yield at, code, None, "incomplete segment"
            return
        yield at, code, length - 2, None
        at += 2 + length


def stream_markers_of(data: bytes) -> Iterator[tuple]:
    """(position, marker, length with its field) of all markers of a stream, tile parts included; other bytes are passed over."""
    if data[:2] == b"\xff\x4f":
        yield 0, START, None
    at = data.find(b"\xff", 2)
    while 0 <= at < len(data) - 1:
        code, step = 0xFF00 | data[at + 1], 1
        if code in SIZED:
            length = struct.unpack_from(">H", data, at + 2)[0] if at + 4 <= len(data) else None
            yield at, code, length
            step = 2 + (length or 0)
        elif code in (DATA, END) or 0xFF30 <= code <= 0xFF3F:
            yield at, code, None
            step = 2
        at = data.find(b"\xff", at + step)


def _scan(df: DataFrame, f, names: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *x) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in f(c or b"")]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=types)

    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    types = pa.schema([(x.split()[0], kinds[x.split()[1]] if "<" not in x else pa.list_(pa.int32())) for x in schema.split(", ")])
    return df.select("path", "content").mapInArrow(run, schema)


def boxes(df: DataFrame) -> DataFrame:
    return _scan(df, boxes_of, ["path", "offset", "header", "length", "type", "error"], "path string, offset long, header int, length long, type string, error string")


def markers(df: DataFrame) -> DataFrame:
    return _scan(df, markers_of, ["path", "position", "marker", "length", "error"], "path string, position long, marker int, length int, error string")


def marker_bodies(df: DataFrame) -> DataFrame:
    """path, position, marker, error and body (null without a segment) of a main header's markers; bodies come from the scan itself, so contents stay where they are read."""
    def found(data: bytes) -> Iterator[tuple]:
        for at, marker, n, error in markers_of(data):
            yield at, marker, error, data[at + 4 : at + 4 + n] if n else None

    return _scan(df, found, ["path", "position", "marker", "error", "body"], "path string, position long, marker int, error string, body binary")


def stream_markers(df: DataFrame) -> DataFrame:
    return _scan(df, stream_markers_of, ["path", "position", "marker", "length"], "path string, position long, marker int, length int")


def planes_of(data: bytes) -> Iterator[tuple]:
    """(component, width, height, bit depth, samples, error) of a P5 or P6 file."""
    fields, at = [], 0
    while len(fields) < 4 and at < len(data):
        end = data.find(b"\n", at)
        line, at = data[at : end if end >= 0 else len(data)], (end + 1 if end >= 0 else len(data))
        if not line.startswith(b"#"):
            fields += line.split()
    n = {b"P5": 1, b"P6": 3}.get(fields[0] if fields else b"")
    if not n or len(fields) != 4 or not all(x.isdigit() for x in fields[1:]):
        yield None, None, None, None, None, "no image header"
        return
    width, height, top = map(int, fields[1:])
    size = 1 if top <= 255 else 2
    if at + width * height * n * size > len(data):
        yield None, width, height, None, None, "missing samples"
        return
    x = np.frombuffer(data, ">u1" if size == 1 else ">u2", width * height * n, at).reshape(-1, n)
    for c in range(n):
        yield c, width, height, 8 * size, x[:, c].astype(int).tolist(), None


def planes(df: DataFrame) -> DataFrame:
    """One row a component: path, c, width, height, bit_depth, data and error."""
    return _scan(df, planes_of, ["path", "c", "width", "height", "bit_depth", "data", "error"], "path string, c int, width int, height int, bit_depth int, data array<int>, error string")


def pixels(planes_: DataFrame) -> DataFrame:
    """Planes in long form: path, c, y, x, v."""
    return planes_.filter("error is null").select("path", "c", "width", F.posexplode("data").alias("i", "v")).select("path", "c", F.floor(F.col("i") / F.col("width")).alias("y"), (F.col("i") % F.col("width")).alias("x"), "v")


def encode_pnm(planes_: DataFrame) -> DataFrame:
    """path and content (BINARY) of P5 or P6 files, 8 bits, from planes of one or three components: a sink's column."""
    hexes = F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), "")
    rows = planes_.groupBy("path", "width", "height").agg(F.array_sort(F.collect_list(F.struct("c", "data"))).alias("p"))
    one = F.when(F.size("p") == 1, F.col("p")[0]["data"]).otherwise(F.flatten(F.transform(F.arrays_zip(F.col("p")[0]["data"].alias("r"), F.col("p")[1]["data"].alias("g"), F.col("p")[2]["data"].alias("b")), lambda q: F.array(q["r"], q["g"], q["b"]))))
    head = F.concat(F.when(F.size("p") == 1, "P5\n").otherwise("P6\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n"))
    return rows.withColumn("v", one).select("path", F.concat(F.encode(head, "UTF-8"), F.unhex(hexes)).alias("content"))


def bins_of(data: bytes) -> Iterator[tuple]:
    """(class, id, start, length, complete) of a codestream's bins: the main header, then each tile part's header and body.

    Container boxes before the codestream are skipped. A codestream without tile parts gives the rest as tile 0.
    """
    base = 0
    if data[:2] != b"\xff\x4f":
        base = next((at + head for at, head, _, kind, error in boxes_of(data) if kind == "jp2c" and not error), None)
        if base is None or data[base : base + 2] != b"\xff\x4f":
            return
    stops = list(markers_of(data[base:]))
    last = stops[-1]
    end = base + last[0] if last[1] == TILE_PART else base + max(p + (2 if m in BARE else 2 + 2 + n) for p, m, n, e in stops if e is None)
    yield "main_header", 0, base, end - base, True
    at, k = end, 0
    while at + 12 <= len(data) and data[at : at + 2] == b"\xff\x90":
        size = struct.unpack_from(">I", data, at + 6)[0]
        stop = len(data) if size == 0 else min(len(data), at + size)
        body = data.find(b"\xff\x93", at, stop)
        body = stop if body < 0 else body + 2
        yield "tile_header", k, at, body - at, True
        yield "tile", k, body, stop - body, size == 0 or at + size <= len(data)
        if stop <= at:
            return
        at, k = stop, k + 1
    if not k and end < len(data):
        yield "tile", 0, end, len(data) - end, True


def data_bins(df: DataFrame) -> DataFrame:
    """path, bin_class, bin_id, start, length and is_complete of each bin; ``bin_data`` cuts its bytes out of content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "bin_class", "bin_id", "start", "length", "is_complete"]
        types = pa.schema([("path", pa.string()), ("bin_class", pa.string()), ("bin_id", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("is_complete", pa.bool_())])
        for batch in batches:
            rows = [dict(zip(names, (p, *x), strict=True)) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in bins_of(c or b"")]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=types)

    return df.select("path", "content").mapInArrow(run, "path string, bin_class string, bin_id int, start long, length long, is_complete boolean")


def bin_data(content: Column, start: Column, length: Column) -> Column:
    return F.substring(content, (start + 1).cast("int"), length.cast("int"))


def encode_box(kind: Column, body: Column) -> Column:
    """A box as BINARY: 4 bytes of length, the type, the body."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body).cast("bigint") + 8), 8, "0")), F.encode(kind, "ISO-8859-1"), body)


def encode_segment(marker: Column, body: Column) -> Column:
    """A marker segment as BINARY: the marker, 2 bytes of length, the body."""
    return F.concat(F.unhex(F.lpad(F.hex(marker.cast("bigint")), 4, "0")), F.unhex(F.lpad(F.hex(F.octet_length(body).cast("bigint") + 2), 4, "0")), body)
