"""Queries of the binary scans: files are built as BINARY columns of the test tables, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources import containers, headers, movies
from .queries import query, table


def _be(value: Column, n: int) -> Column:
    """A number as n bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * n, "0"))


def _files(df: DataFrame, key: str, content: Column) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("path"), content.alias("content"))


_START = b"\xff\x4f"


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'j2k' WHEN 1 THEN 'jp2' WHEN 2 THEN 'jpx' WHEN 3 THEN 'jph' WHEN 4 THEN 'jpm' WHEN 6 THEN 'jp2' WHEN 7 THEN 'jp2' END AS format, o_orderkey % 8 IN (6, 7) AS movie FROM orders""")
def file_formats(spark, d):
    """The main brand alone makes a movie: every second file names it among the compatible ones too."""
    rows, k = table(spark, d, "orders"), F.col("o_orderkey") % 8
    brand = F.element_at(F.array(*[F.lit(x) for x in ("jp2 ", "jpx ", "jph ", "jpm ", "none", "mjp2", "mj2s")]), F.greatest(F.lit(1), k).cast("int"))
    more = F.when(F.col("o_orderkey") % 2 == 0, F.lit(b"mjp2")).otherwise(F.lit(b"none"))
    body = F.concat(F.encode(brand, "US-ASCII"), _be(F.lit(0), 4), more)
    content = F.when(k == 0, F.lit(_START + b"\xff\x51")).when(k == 5, F.lit(b"plain text")).otherwise(F.concat(F.lit(containers.SIGNATURE), containers.encode_box(F.lit("ftyp"), body)))
    return rows.select("o_orderkey", containers.file_format(content).alias("format"), movies.is_movie(content).alias("movie"))


@query("""WITH s AS (SELECT CAST(event_id AS VARCHAR) AS path, strlen(props) AS n FROM events)
SELECT path, 0::BIGINT AS "offset", 8::INTEGER AS header, 8 + n AS length, 'aaaa' AS type, NULL::VARCHAR AS error FROM s UNION ALL SELECT path, 8 + n, 16, 16 + n, 'bbbb', NULL FROM s UNION ALL SELECT path, 24 + 2 * n, 8, 13, 'cccc', NULL FROM s UNION ALL SELECT path, 37 + 2 * n, NULL, NULL, NULL, 'box extends past the end' FROM s""")
def container_boxes(spark, d):
    body = F.encode("props", "UTF-8")
    long_ = F.concat(_be(F.lit(1), 4), F.lit(b"bbbb"), _be(F.octet_length(body) + 16, 8), body)
    return containers.boxes(_files(table(spark, d, "events"), "event_id", F.concat(containers.encode_box(F.lit("aaaa"), body), long_, containers.encode_box(F.lit("cccc"), F.lit(b"tail!")), F.lit(b"\x00\x00\x00\x63dddd"))))


def _stream(rows: DataFrame) -> Column:
    """A codestream from n (levels), w, h and c (components): size, coding style, steps, then two tile parts."""
    n, w, h, c = (F.col(x) for x in "nwhc")
    parts = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), c.cast("int")), lambda k: F.concat(F.lpad(F.hex((k + 6 + F.when(k == 2, 128).otherwise(0)).cast("bigint")), 2, "0"), F.lit("0101"))), ""))
    size = F.concat(_be(F.lit(0), 2), _be(w, 4), _be(h, 4), _be(F.lit(0), 8), _be(w / 2, 4), _be(h / 2, 4), _be(F.lit(0), 8), _be(c, 2), parts)
    coding = F.concat(_be(F.lit(0), 1), _be(n % 5, 1), _be(w % 100 + 1, 2), _be(c % 2, 1), _be(n, 1), _be(F.lit(4), 1), _be(F.lit(3), 1), _be(F.when(w % 3 == 0, 64).otherwise(0), 1), _be(w % 2, 1))
    steps = F.unhex(F.array_join(F.concat(F.array(F.lit("42")), F.transform(F.sequence(F.lit(0), (3 * n).cast("int")), lambda k: F.lpad(F.hex(((k + 8) * 2048 + w % 2048).cast("bigint")), 4, "0"))), ""))
    part = lambda k, body: F.concat(F.lit(b"\xff\x90\x00\x0a"), _be(F.lit(k), 2), _be(F.lit(14) + F.octet_length(body), 4), _be(F.lit(0), 2), F.lit(b"\xff\x93"), body)
    segment = lambda code, body: containers.encode_segment(F.lit(code), body)
    return F.concat(F.lit(_START), segment(headers.SIZE, size), segment(headers.CODING, coding), segment(headers.STEPS, steps), part(0, F.lit(b"abc")), part(1, F.lit(b"defgh")))


def _streams(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("n"), (F.col("o_custkey") % 4000 + 2).alias("w"), (F.col("o_orderkey") % 3000 + 2).alias("h"), (F.col("o_custkey") % 3 + 1).alias("c"))
    return _files(rows, "o_orderkey", _stream(rows))


_STREAMS = "(SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey % 6 AS n, o_custkey % 4000 + 2 AS w, o_orderkey % 3000 + 2 AS h, o_custkey % 3 + 1 AS c FROM orders)"


@query(f"""SELECT path, w AS width, h AS height, w // 2 AS tile_width, h // 2 AS tile_height, c AS components, array_to_string(list_transform(range(1, c + 1), lambda k: CAST(7 + k AS VARCHAR) || (CASE WHEN k = 2 THEN 's' ELSE 'u' END)), ',') AS depths,
 ['LRCP', 'RLCP', 'RPCL', 'PCRL', 'CPRL'][n % 5 + 1] AS progression, w % 100 + 1 AS layers, c % 2 = 1 AS component_transform, n AS levels, 64::BIGINT AS block_width, 32::BIGINT AS block_height, w % 3 = 0 AS high_throughput, w % 2 = 1 AS reversible,
 1 + 3 * n AS bands, round(pow(2.0, 8 - 11.0) * (1 + (w % 2048) / 2048), 6) AS ll, round(CASE WHEN n > 0 THEN pow(2.0, 8 + 3 * n - 11.0) * (1 + (w % 2048) / 2048) END, 6) AS last FROM {_STREAMS}""")
def header_fields(spark, d):
    h = headers.headers(_streams(spark, d))
    depths = F.array_join(F.transform("size.components", lambda c: F.concat(c["bit_depth"].cast("string"), F.when(c["signed"], "s").otherwise("u"))), ",")
    last = F.try_element_at("steps", F.concat(F.lit("HH_"), F.col("coding.levels").cast("string")))
    own = [F.col(f"size.{c}") for c in ("width", "height", "tile_width", "tile_height")]
    return h.select("path", *own, F.size("size.components").cast("bigint").alias("components"), depths.alias("depths"), "coding.*", F.size("steps").cast("bigint").alias("bands"), F.round(F.col("steps")["LL_0"], 6).alias("ll"), F.round(last, 6).alias("last"))


_ENDS = f"(SELECT path, 2 + 40 + 3 * c AS a, 56 + 3 * c AS b, 56 + 3 * c + 7 + 6 * n AS e, n, c FROM {_STREAMS})"


@query(f"""SELECT path, 0 AS "position", 65359 AS marker, 0 AS length, NULL::VARCHAR AS error FROM {_ENDS} UNION ALL SELECT path, 2, 65361, CAST(36 + 3 * c AS INTEGER), NULL FROM {_ENDS} UNION ALL SELECT path, a, 65362, 10, NULL FROM {_ENDS} UNION ALL SELECT path, b, 65372, CAST(3 + 6 * n AS INTEGER), NULL FROM {_ENDS} UNION ALL SELECT path, e, 65424, 0, NULL FROM {_ENDS}""")
def main_markers(spark, d):
    return containers.markers(_streams(spark, d)).withColumn("position", F.col("position").cast("bigint"))


@query(f"""SELECT path, 'main_header' AS bin_class, 0 AS bin_id, 0 AS start, e AS length, true AS is_complete FROM {_ENDS} UNION ALL SELECT path, 'tile_header', 0, e, 14, true FROM {_ENDS} UNION ALL SELECT path, 'tile', 0, e + 14, 3, true FROM {_ENDS} UNION ALL SELECT path, 'tile_header', 1, e + 17, 14, true FROM {_ENDS} UNION ALL SELECT path, 'tile', 1, e + 31, 5, true FROM {_ENDS}""")
def stream_bins(spark, d):
    return containers.data_bins(_streams(spark, d))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS path, c AS c, 2 AS width, 2 AS height, 8 AS bit_depth, CAST(4 * (c_custkey % 200) + 6 + 4 * c AS BIGINT) AS total, CAST(c_custkey % 200 + 3 + c AS BIGINT) AS last FROM customer, (SELECT unnest([0, 1, 2]) AS c) WHERE c = 0 OR c_custkey % 2 = 1""")
def plane_files(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), (F.col("c_custkey") % 200).alias("b"), F.explode(F.when(F.col("c_custkey") % 2 == 1, F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(F.lit(0)))).alias("c"))
    planes = rows.select("path", "c", F.lit(2).alias("width"), F.lit(2).alias("height"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("b") + F.col("c") + i).alias("data"))
    out = containers.planes(containers.encode_pnm(planes)).filter("error is null")
    return out.select("path", "c", "width", "height", "bit_depth", F.aggregate("data", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.element_at("data", 4).cast("bigint").alias("last"))


_MOVIES = """s AS (SELECT user_id AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, length(props) AS size, 40 + event_id % 7 AS duration FROM events),
m AS (SELECT p, count(*) AS n FROM s GROUP BY 1)"""


def _movies(spark, d) -> DataFrame:
    """Two tracks a file: one with tables of all kinds, one with samples of one size. Every seventh file's second track claims 4,294,967,295 samples.

    A picture is as high as its file's number. A track header holds 65,535 at most; image headers in the sample entries hold 32 bits.
    """
    e = table(spark, d, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = e.select("user_id", idx.alias("i"), F.length("props").alias("size"), (40 + F.col("event_id") % 7).alias("duration"))
    hexes = lambda c, n: F.lpad(F.hex(c.cast("bigint")), 2 * n, "0")
    join = lambda a, f: F.unhex(F.array_join(F.transform(a, f), ""))
    per = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "size", "duration"))).alias("s"), F.count(F.lit(1)).alias("n"))
    head = lambda *numbers: F.concat(_be(F.lit(0), 4), *[_be(x if isinstance(x, Column) else F.lit(x), 4) for x in numbers])
    box = lambda kind, *bodies: containers.encode_box(F.lit(kind), F.concat(*bodies))
    chunks = F.sequence(F.lit(0), F.lit(19))
    narrow = box("stco", head(20), join(chunks, lambda k: hexes(k * 10000, 4)))
    wide = box("co64", head(20), join(chunks, lambda k: hexes(k * 10000, 8)))
    sync = F.filter("s", lambda x: x["i"] % 5 == 0)
    stss = F.when(F.col("user_id") % 2 == 0, box("stss", head(F.size(sync)), join(sync, lambda x: hexes(x["i"] + 1, 4)))).otherwise(F.lit(b""))
    image = box("jp2h", box("ihdr", _be(F.col("user_id"), 4), _be(F.lit(640), 4), F.lit(bytes.fromhex("000307070000"))))
    stsd = box("stsd", head(1), box("mjp2", F.lit(bytes(7) + b"\x01" + bytes(70)), image))
    first = box(
        "stbl", stsd, box("stsz", head(0, F.col("n")), join(F.col("s"), lambda x: hexes(x["size"], 4))), F.when(F.col("user_id") % 3 == 0, wide).otherwise(narrow), box("stsc", head(2, 1, 3, 1, 3, 2, 1)),
        box("stts", head(F.col("n")), join(F.col("s"), lambda x: F.concat(hexes(F.lit(1), 4), hexes(x["duration"], 4)))), stss,
    )
    n = F.when(F.col("user_id") % 7 == 0, F.lit(2**32 - 1)).otherwise(F.col("n"))
    second = box("stbl", stsd, box("stsz", head(3, n)), box("stco", head(1, 77)), box("stsc", head(1, 1, n, 1)), box("stts", head(1, n, 10)))
    media = lambda k, stbl: box("trak", box("tkhd", head(0, 0, k, 0, 0), _be(F.lit(0), 52), _be(F.lit(640 * 65536), 4), _be(F.least(F.col("user_id"), F.lit(65535)) * 65536, 4)), box("mdia", box("mdhd", head(0, 0, 600 * k, F.col("n"))), box("hdlr", head(0), F.lit(b"vide")), box("minf", stbl)))
    return _files(per, "user_id", F.concat(box("ftyp", F.lit(b"mjp2")), box("moov", media(1, first), media(2, second))))


@query(f"""WITH {_MOVIES}, c AS (SELECT *, CASE WHEN idx < 6 THEN idx // 3 ELSE 2 + (idx - 6) // 2 END AS chunk FROM s),
f AS (SELECT p, 0 AS track, idx, size, duration, chunk * 10000 + CAST(coalesce(sum(size) OVER (PARTITION BY p, chunk ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(coalesce(sum(duration) OVER (PARTITION BY p ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ts, p % 2 = 1 OR idx % 5 = 0 AS sync, chunk FROM c),
u AS (SELECT p, track, idx, size, duration, "offset", ts, sync FROM f WHERE chunk < 20 UNION ALL SELECT p, 1, idx, 3, 10, 77 + 3 * idx, 10 * idx, true FROM s WHERE p % 7 <> 0)
SELECT CAST(p AS VARCHAR) AS path, track, idx, size, duration, "offset", ts, sync, '' AS error FROM u UNION ALL SELECT CAST(p AS VARCHAR), 1, -1, -1, -1, -1, -1, false, 'samples beyond the file' FROM m WHERE p % 7 = 0""")
def movie_frames(spark, d):
    rows = movies.movie_frames(_movies(spark, d))
    return rows.select("path", "track", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("idx", "size", "duration", "offset", "ts")], F.coalesce("sync", F.lit(False)).alias("sync"), F.coalesce("error", F.lit("")).alias("error"))


@query(f"""WITH {_MOVIES} SELECT CAST(p AS VARCHAR) AS path, k::INTEGER - 1 AS track, k AS track_id, 'vide' AS handler, 600 * k AS timescale, n AS duration, 640::BIGINT AS width, p AS height FROM m, (VALUES (1::BIGINT), (2)) AS t(k)""")
def movie_tracks(spark, d):
    return movies.track_headers(movies.tracks(_movies(spark, d)))


@query(f"""WITH {_MOVIES} SELECT CAST(e.user_id AS VARCHAR) AS path, s.idx, e.props AS text, s.duration, s.idx % 5 = 0 AS sync, CAST(coalesce(sum(s.duration) OVER (PARTITION BY s.p ORDER BY s.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ts FROM s JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events) e ON e.user_id = s.p AND e.idx = s.idx""")
def muxed_movies(spark, d):
    """Frames made into files, and found and cut out again."""
    e = table(spark, d, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = e.select(F.col("user_id").cast("string").alias("path"), idx.alias("idx"), F.encode("props", "UTF-8").alias("data"), (40 + F.col("event_id") % 7).alias("duration"), (idx % 5 == 0).alias("sync"))
    files = movies.movie_files(rows)
    return movies.frame_bytes(files, movies.movie_frames(files)).select("path", "idx", F.decode("data", "UTF-8").alias("text"), "duration", "sync", "ts")


@query("""SELECT o_orderkey, o_custkey % 4096 AS a, (o_custkey * 7) % 4096 AS b, o_orderkey % 4096 AS c, 5::BIGINT AS n_bytes, (o_custkey % 4096) // 16 AS first_byte FROM orders""")
def packed_bits(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", rules.packed(F.array(F.col("o_custkey") % 4096, F.col("o_custkey") * 7 % 4096, F.col("o_orderkey") % 4096), 12).alias("p"))
    read = lambda k: rules.bits_at(F.col("p"), F.lit(12 * k), 12)
    return rows.select("o_orderkey", read(0).alias("a"), read(1).alias("b"), read(2).alias("c"), F.octet_length("p").cast("bigint").alias("n_bytes"), text.big_endian(F.col("p"), 0, 1).alias("first_byte"))


@query("""SELECT event_id, (event_id * 9973) % 65536 AS two, (event_id * 104729) % 4294967296 AS four, CASE WHEN event_id % 2 = 0 THEN 255 END AS past FROM events""")
def big_endian_numbers(spark, d):
    e = F.col("event_id")
    body = F.concat(_be(e * 9973 % 65536, 2), _be(e * 104729 % 2**32, 4), F.when(e % 2 == 0, F.lit(b"\xff")).otherwise(F.lit(b"")))
    return table(spark, d, "events").select("event_id", *[text.big_endian(body, at, n).alias(k) for k, at, n in (("two", 0, 2), ("four", 2, 4), ("past", 6, 1))])
