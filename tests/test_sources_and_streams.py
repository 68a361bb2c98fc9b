"""Binary scans round trip; stream operators keep their state over micro-batches."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from lattika.operators import composition, delivery, recovery, validation
from lattika.sources import containers
from lattika.streaming import state


def box(kind: bytes, body: bytes, extended: bool = False) -> bytes:
    return struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body if extended else struct.pack(">I4s", 8 + len(body), kind) + body


def test_boxes_and_formats(spark, tmp_path):
    signed = containers.SIGNATURE + box(b"ftyp", b"jpx " + b"\0" * 4) + box(b"jp2h", b"x" * 9, True) + struct.pack(">I4s", 0, b"jp2c") + b"\xff\x4fabc"
    bad = {"a.bin": signed, "b.bin": b"\xff\x4f\xff\x51", "c.bin": b"nothing here", "e.bin": struct.pack(">I4s", 3, b"oops"), "f.bin": struct.pack(">I4s", 99, b"long") + b"x"}
    for name, data in bad.items():
        (tmp_path / name).write_bytes(data)
    df = containers.files(spark, str(tmp_path), "*.bin")
    kind = {r.path.rsplit("/", 1)[1]: r.k for r in df.select("path", containers.file_format(F.col("content")).alias("k")).collect()}
    assert kind == {"a.bin": "jpx", "b.bin": "j2k", "c.bin": None, "e.bin": None, "f.bin": None}
    rows = {}
    for r in containers.boxes(df).orderBy("path", "offset").collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append((r.type, r.header, r.length, r.error))
    assert [x[0] for x in rows["a.bin"]] == ["jP  ", "ftyp", "jp2h", "jp2c"] and rows["a.bin"][2][1:3] == (16, 25) and rows["a.bin"][3][2] == 13
    assert rows["e.bin"][0][3].startswith("invalid") and rows["f.bin"][0][3].startswith("box extends")


def test_markers():
    head = b"\xff\x4f" + b"\xff\x51" + struct.pack(">H", 6) + b"abcd" + b"\xff\x64" + struct.pack(">H", 2) + b"\xff\x90"
    assert [x[:3] for x in containers.markers_of(head)] == [(0, 0xFF4F, 0), (2, 0xFF51, 4), (10, 0xFF64, 0), (14, 0xFF90, 0)]
    assert list(containers.markers_of(b"ab"))[0][3] == "no start marker"
    assert list(containers.markers_of(b"\xff\x4f\xff\x01"))[-1][3] == "unknown marker" and list(containers.markers_of(b"\xff\x4f\xff\x51\x00\x09a"))[-1][3] == "incomplete segment"


def test_stream_markers_and_their_checks(spark):
    seg = lambda code, body=b"": code.to_bytes(2, "big") + struct.pack(">H", 2 + len(body)) + body
    tile = seg(0xFF90, b"\0" * 8) + b"\xff\x93" + b"data\xff\x00"
    good = b"\xff\x4f" + seg(0xFF51, b"size") + seg(0xFF52, b"x\xff\xd9") + tile + tile + b"\xff\xd9"
    late = b"\xff\x4f" + seg(0xFF51) + seg(0xFF90, b"\0" * 8) + seg(0xFF52) + seg(0xFF90, b"\0" * 2)
    files = {"good": good, "late": late, "other": b"\x00\x01" + seg(0xFF51), "none": b""}
    m = containers.stream_markers(spark.createDataFrame(list(files.items()), "path string, content binary"))
    assert [r.marker & 0xFF for r in m.filter("path = 'good'").orderBy("position").collect()] == [0x4F, 0x51, 0x52, 0x90, 0x93, 0x90, 0x93, 0xD9]
    got = {r.path: (r.n_markers, r.n_late, r.issues, r.warnings, r.valid) for r in validation.marker_order(m, ["path"]).collect()}
    assert got == {
        "good": (8, 0, [], [], True), "late": (5, 1, ["style_in_tile_part", "end_missing"], ["style_missing"], False),
        "other": (1, 0, ["start_not_first", "end_missing"], ["style_missing"], False),
    }
    parts = sorted((r.path, r.error or "") for r in validation.tile_parts(m, ["path"]).collect())
    assert parts == [("good", ""), ("good", ""), ("late", "no_data"), ("late", "short")]


def test_players_attempts_and_precision(spark):
    at = lambda i, back, loop, step: tuple(spark.range(1).select(*composition.next_frame(F.lit(i), F.lit(3), F.lit(back), F.lit(loop), F.lit(step))).first())
    assert at(1, False, "none", False) == (2, False, True) and at(2, False, "none", False) == (2, False, False)
    assert at(2, False, "loop", False) == (0, False, True) and at(0, True, "loop", False) == (2, True, True)
    assert at(2, False, "ping_pong", False) == (2, True, True) and at(0, True, "ping_pong", True) == (0, False, True)
    rows = spark.createDataFrame([(1, i, ok) for i, ok in enumerate([False, True, False, False, False, True, True])], "s int, i int, ok boolean")
    got = [(r.attempt, r.refused, r.recovered) for r in recovery.attempts(rows, ["s"], ["i"], F.col("ok"), 2).orderBy("i").collect()]
    assert got == [(1, False, False), (2, False, True), (1, False, False), (2, False, False), (3, True, False), (4, True, False), (5, True, False)]
    pairs = spark.createDataFrame([("a", 5, 5), ("b", 0, 255), ("b", 0, 0)], "k string, x int, y int")
    got = {r.k: (r.is_exact, r.max_error, r.passes) for r in validation.precision(pairs, ["k"], F.col("x"), F.col("y"), 8, 10.0).collect()}
    assert got == {"a": (True, 0, True), "b": (False, 255, False)}


def test_planes_round_trip(spark, tmp_path):
    (tmp_path / "g.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes([1, 2, 3, 250, 251, 252]))
    (tmp_path / "c.ppm").write_bytes(b"P6\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "w.pgm").write_bytes(b"P5\n1 1\n65535\n\x01\x02")
    (tmp_path / "x.pgm").write_bytes(b"P5\n9 9\n255\nshort")
    p = containers.planes(containers.files(spark, str(tmp_path)))
    got = {(r.path.rsplit("/", 1)[1], r.c): r.data for r in p.filter("error is null").collect()}
    assert got == {("g.pgm", 0): [1, 2, 3, 250, 251, 252], ("c.ppm", 0): [1, 4], ("c.ppm", 1): [2, 5], ("c.ppm", 2): [3, 6], ("w.pgm", 0): [258]}
    assert p.filter("error is not null").count() == 1 and containers.pixels(p).filter("c = 0 and y = 1 and x = 2").first().v == 252
    out = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in containers.encode_pnm(p.filter("error is null and bit_depth = 8")).collect()}
    assert out["c.ppm"] == b"P6\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]) and out["g.pgm"] == b"P5\n3 2\n255\n" + bytes([1, 2, 3, 250, 251, 252])


def test_bucket():
    assert state.bucket_step(2000, None, 0, 500, 1000) == (1500, 0, True)
    assert state.bucket_step(100, 0, 300_000, 500, 1000) == (400, 300_000, False)
    assert state.bucket_step(100, 0, 100_000_000, 500, 1000) == (1500, 100_000_000, True)
    # half a token's time is kept for the next request
    assert state.bucket_step(0, 0, 500, 1, 1000) == (0, 0, False) and state.bucket_step(0, 0, 1000, 1, 1000) == (0, 1000, True)


def at(second):
    return datetime.datetime(2024, 1, 1, 0, 0, second)


def run_stream(spark, tmp_path, op, schema, batches):
    src, out, done = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(src / f"b{i}"))
        q = op(spark.readStream.schema(schema).json(f"{src}/*")).writeStream.format("json").outputMode("append").option("checkpointLocation", done).trigger(availableNow=True).start(out)
        q.awaitTermination(90)
        assert q.exception() is None
    return spark.read.json(out)


def test_rate_limit_stream(spark, tmp_path):
    got = run_stream(spark, tmp_path, lambda s: state.rate_limit(s, 1000), "client string, ts timestamp, bytes long", [
        [("a", at(x), n) for x, n in ((0, 1500), (0, 600), (1, 1400))],
        [("a", at(2), 1000), ("b", at(2), 2001)],
    ])
    # full at 2,000: 1,500 pass, 600 don't, a second later 1,500 are there, then 100 + 1,000
    assert sorted((r.client, r.bytes, r.allowed) for r in got.collect()) == [("a", 600, False), ("a", 1000, True), ("a", 1400, True), ("a", 1500, True), ("b", 2001, False)]


def test_bandwidth_stream(spark, tmp_path):
    got = run_stream(spark, tmp_path, state.bandwidth_estimates, "client string, ts timestamp, bytes long, seconds double, rtt double", [[("a", at(0), 100000, 0.5, 50.0), ("a", at(1), 200000, 0.5, 55.0)], [("a", at(2), 150000, 0.5, 150.0)]])
    rows = sorted(got.collect(), key=lambda r: r.ts)
    e = 5_000_000.0
    for r, x in zip(rows, (200000, 400000, 300000), strict=True):
        e = 0.3 * x + 0.7 * e
        assert r.estimate == pytest.approx(e)
    assert [r.congested for r in rows] == [False, False, True] and rows[1].trend == 1.0 and rows[2].trend == pytest.approx(0.5)


def test_bandwidth_after_nothing(spark, tmp_path):
    """0.3 is what 0.7 leaves, to the last bit; a trend that starts at 0 is what is asked for."""
    op = lambda s: state.bandwidth_estimates(s, from_nothing=1.0)
    got = run_stream(spark, tmp_path, op, "client string, ts timestamp, bytes long, seconds double, rtt double", [[("a", at(0), 0, 0.5, 50.0), ("a", at(1), 77, 0.5, 50.0)]])
    first, second = sorted(got.collect(), key=lambda r: r.ts)
    assert (first.trend, second.trend) == (0.0, 1.0) and second.estimate == 0.3 * 154 + 0.7 * (0.7 * 5_000_000)


def test_sides_beyond_a_track_header(spark):
    """A side above 65,535 comes from the image header of the sample entry; smaller ones from the track header."""
    import struct

    from lattika.sources import movies

    box = lambda kind, *parts: struct.pack(">I", 8 + sum(map(len, parts))) + kind + b"".join(parts)
    image = box(b"jp2h", box(b"ihdr", struct.pack(">II", 70_000, 123), bytes(6)))
    stsd = box(b"stsd", struct.pack(">II", 0, 1), box(b"mjp2", bytes(78), image))
    for entry, want in ((stsd, 70_000), (b"", 65_535)):
        track = box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", 640 << 16, 65_535 << 16)), box(b"mdia", box(b"mdhd", bytes(20)), box(b"minf", box(b"stbl", entry))))
        df = spark.createDataFrame([("a", bytearray(box(b"moov", track)))], "path string, content binary")
        assert movies.track_headers(movies.tracks(df)).select("width", "height").collect() == [(640, want)]


def test_sent_once_and_sessions_plan(spark):
    s = spark.readStream.format("rate").load().withColumn("k", F.col("value") % 3)
    assert state.sent_once(s, ["k"], "timestamp").isStreaming and state.stream_sessions(s, ["k"], "timestamp", "5 minutes").isStreaming


def test_layers_skip_what_overflows(spark):
    rows = [("i", 1, 0, 50.0, 9.0), ("i", 2, 0, 60.0, 8.0), ("i", 3, 0, 40.0, 7.0), ("i", 4, 0, 10.0, 6.0)]
    df = spark.createDataFrame(rows, "k string, block int, number int, size double, slope double")
    taken = lambda b: sorted(r.block for r in delivery.form_layers(df, ["k"], b, "block", "number", "size", "slope").collect())
    assert taken(100.0) == [1, 3, 4] and taken(94.0) == [1, 3] and taken(10.0) == [1] and taken(1000.0) == [1, 2, 3, 4] and taken(105.0) == [1, 3, 4]


def test_data_bins_and_encoders(spark, tmp_path):
    main = b"\xff\x4f" + b"\xff\x51" + struct.pack(">H", 6) + b"abcd"
    part = lambda body: b"\xff\x90" + struct.pack(">HHIBB", 10, 0, 14 + len(body), 0, 1) + b"\xff\x93" + body
    stream = main + part(b"one") + part(b"three") + b"\xff\xd9"
    (tmp_path / "a.bin").write_bytes(stream)
    (tmp_path / "b.bin").write_bytes(containers.SIGNATURE + struct.pack(">I4s", 8 + len(stream), b"jp2c") + stream)
    (tmp_path / "c.bin").write_bytes(b"junk, no stream")
    df = containers.files(spark, str(tmp_path))
    rows = containers.data_bins(df).join(df.select("path", "content"), "path").select("path", "bin_class", "bin_id", containers.bin_data(F.col("content"), F.col("start"), F.col("length")).alias("d")).collect()
    for name in ("a.bin", "b.bin"):
        got = {(r.bin_class, r.bin_id): bytes(r.d) for r in rows if r.path.endswith(name)}
        assert got["main_header", 0] == main and got["tile", 0] == b"one" and got["tile", 1] == b"three" and len(got) == 5
    assert not [r for r in rows if r.path.endswith("c.bin")]
    r = spark.range(1).select(containers.encode_box(F.lit("ftyp"), F.lit(b"xyz")).alias("b"), containers.encode_segment(F.lit(0xFF51), F.lit(b"abcd")).alias("m")).first()
    assert bytes(r.b) == box(b"ftyp", b"xyz") and bytes(r.m) == b"\xff\x51\x00\x06abcd"
    assert [x.target_bits for x in delivery.equal_layers(spark, 2, 10, 40).collect()] == [2.0, 4.0]


def test_headers_of_short_and_foreign_files(spark):
    from lattika.sources import headers, movies

    rows = [("empty", b""), ("none", None), ("cut", b"\xff\x4f\xff\x51\x00\x04\x00\x00"), ("other", b"plain"), ("boxes", b"\x00\x00\x00\x08moov")]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r for r in headers.headers(files).collect()}
    assert set(got) == {"cut"} and got["cut"].size.width is None and got["cut"].steps is None
    assert movies.movie_frames(files).count() == 0
    assert [r.m for r in files.orderBy("path").select(movies.is_movie(F.col("content")).alias("m")).collect()] == [False] * 5


def test_bits_past_the_end(spark):
    from lattika.functions import rules

    row = spark.range(1).select(rules.bits_at(F.lit(b"\xa5\x0f"), F.lit(4), 8).alias("a"), rules.bits_at(F.lit(b"\xa5\x0f"), F.lit(12), 5).alias("b"), rules.bits_at(F.lit(b"\x01\x02\x03\x04\x05"), F.lit(7), 32).alias("c")).first()
    assert row.a == 0x50 and row.b is None and row.c == (0x0102030405 >> 1) & 0xFFFFFFFF


def test_movies_with_damaged_counts(spark):
    from lattika.sources import movies

    def track(stsz, stts=(1, 10), stsc=(1, 1), tail=b""):
        n = lambda *x: struct.pack(f">{len(x)}I", *x)
        stbl = box(b"stsz", n(0, *stsz)) + box(b"stco", n(0, 1, 8)) + box(b"stsc", n(0, 1, 1, stsc[1], 1)) + box(b"stts", n(0, 1, *stts)) + tail
        return box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stbl))))

    top = 2**32 - 1
    content = box(b"moov", b"".join([track((0, 2, 5, 6), (top, 10), (1, top)), track((1, top)), track((0, top, 5)), track((0, 1, 5), tail=box(b"stss", struct.pack(">2I", 0, top))), box(b"trak", b"")]))
    signed = bytes.fromhex("0000000C6A5020200D0A870A")
    rows = [("a", content), ("b", signed + box(b"ftyp", b"mj2s\0\0\0\0")), ("c", signed + box(b"ftyp", b"jp2 \0\0\0\0mjp2")), ("d", signed + box(b"ftyp", b"mjp2"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = movies.movie_frames(files).collect()
    assert sorted((r.track, r.idx, r.size, r.duration, r.offset, r.ts, r.sync) for r in got if r.error is None) == [(0, 0, 5, 10, 8, 0, True), (0, 1, 6, 10, 13, 10, True)]
    assert sorted((r.track, r.error) for r in got if r.error) == [(1, "samples beyond the file"), (2, "samples beyond the file"), (3, "entries beyond stss"), (4, "no stsz")]
    assert {r.path: r.m for r in files.select("path", movies.is_movie(F.col("content")).alias("m")).collect()} == {"a": False, "b": True, "c": False, "d": True}
    cut = movies.frame_bytes(files, movies.movie_frames(files)).collect()
    assert sorted(bytes(r.data) for r in cut) == sorted([content[8:13], content[13:19]])
