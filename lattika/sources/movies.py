"""Movies: tracks and their headers, frames of every track from its sample tables, frame bytes, and files made of frames.

One pass over a file finds its tracks; a track is then one row of small bodies, and all else are expressions and joins over these. Counts in a
table that its own bytes, or the file's, can't hold make the track an error, so that no damaged number is expanded; the other tracks and files are not touched.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import big_endian
from ..operators.delivery import frame_table
from ..operators.staging import staged
from .containers import SIGNATURE, boxes_of, encode_box

# Brands of movies, the boxes around a sample table, its tables, and the headers of a track.
MOVIE_BRANDS = (b"mjp2", b"mj2s")
TABLE_PATH = ("mdia", "minf", "stbl")
TABLES = ("stsz", "stco", "co64", "stsc", "stts", "stss")
HEADERS = ("tkhd", "mdhd", "hdlr", "ihdr")
#: Bytes before a sample entry's first box: those of the list, the entry's own head, and its fixed fields.
ENTRY = 8 + 8 + 78
#: The greatest side that a track header can hold.
FULL = 65535


def is_movie(content: Column) -> Column:
    """Whether a file has the signature, then a type box whose main brand is one of movies; compatible brands don't count."""
    at = lambda a, n: F.substring(content, a, n)
    return F.coalesce((at(1, 12) == F.lit(SIGNATURE)) & (at(17, 4) == F.lit(b"ftyp")) & at(21, 4).isin(*MOVIE_BRANDS), F.lit(False))


def _inside(data: bytes, kind: str) -> Iterator[bytes]:
    return (data[at + head : at + length] for at, head, length, name, error in boxes_of(data) if not error and name == kind)


def _fault(of: dict[str, bytes], file_bytes: int) -> tuple[int, str | None]:
    """How many samples a track has, and what is wrong with its tables."""
    def number(name: str, at: int) -> int:
        return struct.unpack_from(">I", of[name], at)[0]

    chunks = "stco" if "stco" in of else "co64"
    for name, least in (("stsz", 12), (chunks, 8), ("stsc", 8), ("stts", 8)):
        if len(of.get(name, b"")) < least:
            return 0, f"no {name}"
    one, n = number("stsz", 4), number("stsz", 8)
    if one == 0 and 12 + 4 * n > len(of["stsz"]) or one * n > file_bytes:
        return 0, "samples beyond the file"
    for name, width in ((chunks, 4 if chunks == "stco" else 8), ("stsc", 12), ("stts", 8), ("stss", 4)):
        if name in of and (len(of[name]) < 8 or 8 + width * number(name, 4) > len(of[name])):
            return n, f"entries beyond {name}"
    return n, None


def tracks_of(data: bytes) -> Iterator[tuple]:
    """(track, samples, error, bodies of the headers and tables, in their order) of each track box of a file."""
    movie = next(_inside(data, "moov"), None)
    for k, track in enumerate(_inside(movie, "trak") if movie is not None else ()):
        media = next(_inside(track, "mdia"), b"")
        of = {"tkhd": next(_inside(track, "tkhd"), None)} | {name: next(_inside(media, name), None) for name in ("mdhd", "hdlr")}
        table = track
        for name in TABLE_PATH:
            table = next(_inside(table, name), b"")
        entry = next(_inside(table, "stsd"), b"")[ENTRY:]
        of["ihdr"] = next(_inside(next(_inside(entry, "jp2h"), b""), "ihdr"), None)
        of |= {name: body for name in TABLES for body in [next(_inside(table, name), None)]}
        yield k, *_fault({a: b for a, b in of.items() if b is not None}, len(data)), *(of[name] for name in (*HEADERS, *TABLES))


def tracks(files: DataFrame) -> DataFrame:
    """path, track (from 0), samples, error and the bodies of headers and tables of each track in ``files`` (path, content)."""
    names = ["path", "track", "samples", "error", *HEADERS, *TABLES]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), *[pa.binary()] * len(HEADERS + TABLES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, *x) for x in tracks_of(content or b"")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, track int, samples long, error string, " + ", ".join(f"{x} binary" for x in HEADERS + TABLES))


def track_headers(found: DataFrame) -> DataFrame:
    """path, track, track_id, handler, timescale, duration (of the media), width and height of ``tracks``; both versions of the headers are read.

    A track header has 16 bits for a side. Where these are full, the image header of the track's first sample entry tells the side, if there is one.
    """
    wide_t, wide_m = big_endian(F.col("tkhd"), 0, 1) == 1, big_endian(F.col("mdhd"), 0, 1) == 1
    t, m = (lambda a, b: F.when(wide_t, big_endian(F.col("tkhd"), b, 4)).otherwise(big_endian(F.col("tkhd"), a, 4))), (lambda a, b: F.when(wide_m, big_endian(F.col("mdhd"), b, 4)).otherwise(big_endian(F.col("mdhd"), a, 4)))
    long_ = big_endian(F.col("mdhd"), 24, 4) * F.lit(2**32) + big_endian(F.col("mdhd"), 28, 4)
    handler = F.when(F.octet_length("hdlr") >= 12, F.decode(F.substring("hdlr", F.lit(9), F.lit(4)), "ISO-8859-1"))


    def side(a: int, b: int, image: int) -> Column:
        short = F.floor(t(a, b) / 65536).cast("long")
        return F.when(short == FULL, F.greatest(short, big_endian(F.col("ihdr"), image, 4))).otherwise(short)

    return found.select("path", "track", t(12, 20).alias("track_id"), handler.alias("handler"), m(12, 20).alias("timescale"), F.when(wide_m, long_).otherwise(big_endian(F.col("mdhd"), 16, 4)).alias("duration"), side(76, 88, 4).alias("width"), side(80, 92, 0).alias("height"))


def _entries(body: Column, first: int, width: int, f) -> Column:
    """f(offset) for each of the entries that the number before ``first`` counts."""
    n = big_endian(body, first - 4, 4)
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))), lambda k: f(F.lit(first) + width * k))


def frames_of(found: DataFrame) -> DataFrame:
    """path, track, idx, size, duration, offset, ts, sync and error of each frame of ``tracks``; a faulty track is one row with its error.

    Without a list of sync samples every frame is one. Tables become rows, and frames come from joins and running sums of these.
    """
    found = staged(found)
    ok = found.filter("error is null").withColumn("key", F.struct("path", "track"))
    n4 = lambda name: lambda at: big_endian(F.col(name), at, 4)
    key, samples = F.col("key").alias("track"), F.col("samples")
    one = n4("stsz")(F.lit(4))
    sizes = ok.select(key, F.posexplode(F.when(one > 0, F.array_repeat(one, samples.cast("int"))).otherwise(_entries(F.col("stsz"), 12, 4, n4("stsz")))).alias("idx", "size"))
    offsets = F.when(F.col("stco").isNotNull(), _entries(F.col("stco"), 8, 4, n4("stco"))).otherwise(_entries(F.col("co64"), 8, 8, lambda at: n4("co64")(at) * F.lit(2**32) + n4("co64")(at + 4)))
    chunks = ok.select(key, F.posexplode(offsets).alias("chunk", "offset")).withColumn("chunk", F.col("chunk").cast("bigint"))
    runs = ok.select(key, F.inline(_entries(F.col("stsc"), 8, 12, lambda at: F.struct(n4("stsc")(at).alias("first_chunk"), F.least(n4("stsc")(at + 4), samples).alias("per_chunk")))))
    spans = ok.select(key, "samples", F.posexplode(_entries(F.col("stts"), 8, 8, lambda at: F.struct(n4("stts")(at).alias("n"), n4("stts")(at + 4).alias("duration")))).alias("k", "e"))
    # a run's first sample; runs beyond the last sample give none
    before = F.coalesce(F.sum("e.n").over(Window.partitionBy("track").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("_first", before).withColumn("_n", F.least(F.col("e.n"), F.col("samples") - F.col("_first"))).filter("_n > 0")
    timed = spans.select("track", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("idx"), "e.duration")
    listed = sizes.withColumn("idx", F.col("idx").cast("bigint")).join(timed, ["track", "idx"], "left").select("track", "idx", "size", F.coalesce("duration", F.lit(0)).alias("duration"))
    frames = frame_table(listed, chunks, runs)
    sync = ok.select(key, F.explode_outer(F.transform(_entries(F.col("stss"), 8, 4, n4("stss")), lambda x: x - 1)).alias("idx"), F.lit(True).alias("_sync")).filter("idx is not null").distinct()
    every = ok.filter("stss is null").select(key, F.lit(True).alias("_every"))
    out = frames.join(sync, ["track", "idx"], "left").join(every, "track", "left")
    out = out.select("track.path", F.col("track.track").alias("track"), "idx", "size", "duration", "offset", "ts", F.coalesce("_sync", "_every", F.lit(False)).alias("sync"), F.lit(None).cast("string").alias("error"))
    bad = found.filter("error is not null").select("path", "track", *[F.lit(None).cast(t).alias(c) for c, t in out.dtypes if c not in ("path", "track", "error")], "error")
    return out.unionByName(bad)


def movie_frames(files: DataFrame) -> DataFrame:
    return frames_of(tracks(files))


def frame_bytes(files: DataFrame, frames: DataFrame) -> DataFrame:
    """frames (path, offset, size and others, of ``movie_frames`` or a selection of these) with data (BINARY), null where the file ends before. A file's contents move once."""
    names = [c for c in frames.columns if c != "path"]
    per = frames.filter("offset is not null").groupBy("path").agg(F.collect_list(F.struct(*names)).alias("_f"))
    whole = lambda f: F.when(f["offset"] + f["size"] <= F.octet_length("content"), F.substring("content", (f["offset"] + 1).cast("int"), f["size"].cast("int")))
    rows = files.select("path", "content").join(per, "path").select("path", F.transform("_f", lambda f: F.struct(*[f[c].alias(c) for c in names], whole(f).alias("data"))).alias("_f"))
    return rows.select("path", F.inline("_f"))


def _be(value: Column, n: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")


def _table(numbers: Column) -> Column:
    """A version, a count, and what hex texts hold."""
    return F.unhex(F.concat(F.lit("00000000"), _be(F.size(numbers), 4), F.array_join(numbers, "")))


def movie_files(frames: DataFrame, per_chunk: int = 8, timescale: int = 600, brand: str = "mjp2") -> DataFrame:
    """path and content (BINARY) of movies with one track, from frames (path, idx, data, duration, sync): a sink's column.

    Durations are written as runs, chunks as runs of ``per_chunk`` frames and a shorter last one; a list of sync samples is written unless all are. A file is one
    value, and so must stay below 2 GB. Boxes are built from the inside, so every length is known when its box is written.
    """
    w = Window.partitionBy("path").orderBy("idx")
    rows = frames.withColumn("_new", F.when(F.lag("duration").over(w).eqNullSafe(F.col("duration")), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    runs = rows.groupBy("path", "_run").agg(F.count(F.lit(1)).alias("_n"), F.first("duration").alias("_d"))
    runs = runs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_run", "_n", "_d"))).alias("_runs"))
    per = frames.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "data", "duration", "sync"))).alias("_f")).join(runs, "path")
    n, box = F.size("_f"), lambda kind, *parts: encode_box(F.lit(kind), F.concat(*parts))
    start = F.concat(F.lit(SIGNATURE), box("ftyp", F.lit(brand.encode() + bytes(4) + brand.encode())))
    per = per.withColumn("_head", start).withColumn("_mdat", encode_box(F.lit("mdat"), F.unhex(F.array_join(F.transform("_f", lambda f: F.hex(f["data"])), ""))))
    sizes = F.transform("_f", lambda f: F.octet_length(f["data"]).cast("bigint"))
    per = per.withColumn("_sizes", sizes).withColumn("_chunks", F.ceil(n / per_chunk))
    begin = F.transform(F.sequence(F.lit(0), (F.col("_chunks") - 1).cast("int")), lambda k: F.octet_length("_head") + 8 + F.aggregate(F.slice("_sizes", 1, k * per_chunk), F.lit(0).cast("bigint"), lambda a, x: a + x))
    rest = n % per_chunk
    whole = F.array(F.concat(_be(F.lit(1), 4), _be(F.lit(per_chunk), 4), _be(F.lit(1), 4)))
    last = F.concat(_be(F.col("_chunks"), 4), _be(rest, 4), _be(F.lit(1), 4))
    stsc = F.when(rest == 0, whole).when(n < per_chunk, F.array(last)).otherwise(F.concat(whole, F.array(last)))
    synced = F.filter(F.transform("_f", lambda f, i: F.when(f["sync"], _be(i + 1, 4))), lambda x: x.isNotNull())
    stss = F.when(F.size(synced) < n, encode_box(F.lit("stss"), _table(synced))).otherwise(F.lit(b""))
    stsz = F.unhex(F.concat(F.lit("0000000000000000"), _be(n, 4), F.array_join(F.transform("_sizes", lambda x: _be(x, 4)), "")))
    stbl = box("stbl", box("stsz", stsz), box("stco", _table(F.transform(begin, lambda x: _be(x, 4)))), box("stsc", _table(stsc)), box("stts", _table(F.transform("_runs", lambda r: F.concat(_be(r["_n"], 4), _be(r["_d"], 4))))), stss)
    total = F.aggregate("_f", F.lit(0).cast("bigint"), lambda a, f: a + f["duration"])
    mdhd = box("mdhd", F.unhex(F.concat(F.lit("00" * 12), _be(F.lit(timescale), 4), _be(total, 4), F.lit("55C40000"))))
    tkhd = box("tkhd", F.unhex(F.concat(F.lit("00000007" + "00" * 8), _be(F.lit(1), 4), F.lit("00" * 4), _be(total, 4), F.lit("00" * 60))))
    moov = box("moov", box("trak", tkhd, box("mdia", mdhd, box("hdlr", F.lit(bytes(8) + b"vide" + bytes(13))), box("minf", stbl))))
    return per.select("path", F.concat("_head", "_mdat", moov).alias("content"))
