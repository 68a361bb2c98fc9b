"""Expected values of single operators, edge cases included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattika.functions import color, nonlinear, quantize, text
from lattika.operators import lifting, palette, rank, regions, spectral, stats, timeline


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_reversible_transform_is_exact(spark):
    df = spark.createDataFrame([(0, 0, 0), (255, 0, 128), (-5, 7, -9), (2**31 - 1, -(2**31), 3)], "r long, g long, b long")
    y, cb, cr = color.rct_forward(F.col("r"), F.col("g"), F.col("b"))
    back = df.select("r", "g", "b", y.alias("y"), cb.alias("cb"), cr.alias("cr")).select("r", "g", "b", *[c.alias(k) for c, k in zip(color.rct_inverse(F.col("y"), F.col("cb"), F.col("cr")), ("r2", "g2", "b2"), strict=True)])
    assert all((x.r, x.g, x.b) == (x.r2, x.g2, x.b2) for x in back.collect())


def test_matrix_helpers():
    m = ((2.0, 1.0), (1.0, 1.0))
    assert color.reconstructs(m) and color.transpose(m) == ((2.0, 1.0), (1.0, 1.0))
    with pytest.raises(ValueError):
        color.invert(((1.0, 2.0), (2.0, 4.0)))


@pytest.mark.parametrize("n", [2, 3, 5, 8, 64])
@pytest.mark.parametrize("boundary", ["symmetric", "periodic", "zero"])
def test_lifting_round_trips(spark, n, boundary):
    import random

    s = [random.Random(n).randrange(-500, 500) for _ in range(n)]
    df = spark.createDataFrame([(s, [float(x) for x in s])], "s array<bigint>, f array<double>")
    bands = df.select("s", "f", lifting.forward53(F.col("s"), boundary).alias("b"), lifting.forward97(F.col("f"), boundary).alias("c"))
    got = bands.select("s", "f", lifting.inverse53(F.col("b.low"), F.col("b.high"), boundary).alias("s2"), lifting.inverse97(F.col("c.low"), F.col("c.high"), boundary).alias("f2")).first()
    assert got.s2 == s
    assert got.f2 == pytest.approx(got.f, abs=1e-6)


def test_one_level_53_by_hand(spark):
    got = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7, 8],)], "s array<bigint>").select(lifting.forward53(F.col("s")).alias("b")).first().b
    assert got.high == [0, 0, 0, 1] and got.low == [1, 3, 5, 7]


def test_two_dimensional_round_trip(spark):
    m = [[(7 * y + 3 * x * x) % 50 for x in range(7)] for y in range(6)]
    df = spark.createDataFrame([(m,)], "m array<array<bigint>>")
    got = df.select(lifting.forward_2d(F.col("m")).alias("b")).select("b.ll", lifting.inverse_2d(F.col("b")).alias("m")).first()
    assert got.m == m and len(got.ll) == 3 and len(got.ll[0]) == 4


def test_quantisers(spark):
    df = spark.createDataFrame([(float(x),) for x in (-10, -3.75, -1, 0, 1, 3.75, 10)], "c double")
    q = [x[0] for x in df.select(quantize.scalar(F.col("c"), F.lit(2.5))).collect()]
    assert q == [-4, -1, 0, 0, 0, 1, 4]
    d = [x[0] for x in df.select(quantize.deadzone(F.col("c"), F.lit(2.5), 3.0)).collect()]
    assert d == [-3, 0, 0, 0, 0, 0, 3]
    assert one(spark, quantize.dequantize_midpoint(F.lit(-2), F.lit(2.0)))[0] == -5.0
    assert one(spark, quantize.shift_down(quantize.shift_up(F.lit(-9), F.lit(True), 5), 5))[0] == -9
    assert one(spark, quantize.round_mode(F.lit(2.5), "nearest-even"), quantize.round_mode(F.lit(-2.5), "nearest"), quantize.round_mode(F.lit(-2.7), "truncate"))[:] == (2.0, -3.0, -2.0)
    assert quantize.volume_step("lossless", 8, 3) == 1.0 and quantize.volume_step("bitrate", 8, 3, 2.0) == 32.0


@pytest.mark.parametrize("kind,parameter", [("gamma", 2.2), ("log", None), ("exp", None), ("pq", None), ("hlg", None), ("identity", None)])
def test_curves_invert(spark, kind, parameter):
    df = spark.range(0, 4096, 97).select(F.col("id").cast("double").alias("v"))
    n = F.col("v") / 4095.0
    f = nonlinear.curve(n, kind, parameter)
    rows = df.select("v", (nonlinear.curve(f, kind, parameter, inverse=True) * 4095).alias("w")).collect()
    assert all(r.w == pytest.approx(r.v, abs=2e-2) for r in rows)


def test_table_curve(spark):
    assert [round(x[0], 6) for x in spark.createDataFrame([(0.0,), (0.25,), (1.0,)], "n double").select(nonlinear.curve(F.col("n"), "table", [0.0, 0.5, 0.6])).collect()] == [0.0, 0.25, 0.6]


def test_spectral(spark):
    r = one(spark, spectral.normalized_difference(F.lit(0.2), F.lit(0.6)), spectral.normalized_difference(F.lit(0.0), F.lit(0.0)))
    assert r[0] == pytest.approx(0.5) and r[1] == 0
    bands = spark.createDataFrame([(0, 490.0), (1, 665.0), (2, 841.0), (3, 843.0)], "band int, wavelength_nm double")
    assert spectral.nearest_band(bands, 842).first().band == 2
    df = spark.createDataFrame([(0.1, 0.4, 5.0), (0.2, 0.3, 5.0), (0.3, 0.2, 5.0), (0.4, 0.1, 5.0)], "a double, b double, k double")
    m = {(x.i, x.j): x.r for x in stats.correlation_matrix(df, ["a", "b", "k"]).collect()}
    assert m[0, 0] == 1 and m[0, 1] == pytest.approx(-1) and m[0, 2] == 0 and m[2, 2] == 1


def test_palette(spark):
    df = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (128, 128, 0), (255, 0, 0), (0, 255, 0), (250, 5, 0)], "r int, g int, b int")
    p = palette.create_palette(df, "r", "g", "b", 2)
    assert [(x.idx, x.r, x.g, x.b) for x in p.orderBy("idx").collect()] == [(0, 0, 255, 0), (1, 255, 0, 0)]
    assert sorted(x.idx for x in palette.assign(df, p, "r", "g", "b").collect()) == [0, 0, 0, 1, 1, 1]
    bad = spark.createDataFrame([(7,)], "i long")
    with pytest.raises(Exception, match="out of range"):
        palette.expand(bad, p, "i").collect()


def test_regions(spark):
    assert one(spark, *[regions.tile_grid(F.lit(x), F.lit(32)) for x in (0, 32, 33)])[:] == (1, 1, 2)
    assert regions.tiles(spark, (100, 70, 20), (32, 32, 16)).count() == 24
    assert regions.tiles(spark, (100, 70, 20), (32, 32, 16), (200, 300, 0, 1, 0, 1)).count() == 0
    pts = spark.range(20).withColumnRenamed("id", "x").crossJoin(spark.range(20).withColumnRenamed("id", "y"))
    square = [(2, 3), (11, 3), (11, 9), (2, 9)]
    assert pts.filter(regions.polygon(F.col("x"), F.col("y"), square)).count() == 9 * 6
    assert pts.filter(regions.rectangle(F.col("x"), F.col("y"), 2, 3, 9, 6)).count() == 9 * 6
    m = regions.wavelet_mask(pts.withColumn("mask", (F.col("x") == 3) & (F.col("y") == 0)), 0).filter("mask").collect()
    assert [(r.subband, r.y, r.x) for r in m] == [("HL", 0, 1)]


def test_interval_join_finds_each_pair_once(spark):
    import random

    rnd = random.Random(1)
    a = [(i, x, x + rnd.randrange(0, 40)) for i in range(60) for x in [rnd.randrange(300)]]
    b = [(i, x, x + rnd.randrange(0, 40)) for i in range(60) for x in [rnd.randrange(300)]]
    got = regions.interval_join(spark.createDataFrame(a, "a_id long, a0 long, a1 long"), spark.createDataFrame(b, "b_id long, b0 long, b1 long"), 16).select("a_id", "b_id").collect()
    want = sorted((i, j) for i, a0, a1 in a for j, b0, b1 in b if a0 < a1 and b0 < b1 and a0 < b1 and a1 > b0)
    assert sorted((r.a_id, r.b_id) for r in got) == want


def test_timeline(spark):
    f = spark.createDataFrame([(i, "t", 1000, 1000) for i in range(10)], "idx int, track string, size long, duration long")
    f = f.withColumn("ts", timeline.running_before(F.col("duration"), ["track"], ["idx"]))
    assert sorted(r.idx for r in f.filter(timeline.overlapping(F.col("ts"), F.col("duration"), 2000, 5000)).collect()) == [2, 3, 4]
    assert timeline.nearest(f, ["track"], F.col("ts"), F.lit(2500), "idx").first().idx == 2
    s = spark.createDataFrame([("a", 0.0), ("a", 100.0), ("a", 30000.0), ("b", 5.0)], "k string, t double").withColumn("at", F.timestamp_seconds("t"))
    assert sorted((r.k, r.session) for r in timeline.sessions(s, ["k"], "at", 3600).collect()) == [("a", 0), ("a", 0), ("a", 1), ("b", 0)]
    assert one(spark, timeline.predict_bandwidth(F.lit(1000000.0), F.lit(-0.5), F.lit(True)))[0] == 595000


def test_orders(spark):
    z = spark.range(4, 9).withColumnRenamed("id", "z")
    order = lambda mode: [r.z for r in z.orderBy(rank.slice_order(F.col("z"), 4, 9, mode)).collect()]
    assert order("forward") == [4, 5, 6, 7, 8] and order("reverse") == [8, 7, 6, 5, 4] and order("centre") == [6, 7, 5, 8, 4]
    items = spark.createDataFrame([("q", 1, 50), ("q", 2, 60), ("q", 3, 1)], "k string, o int, size long")
    assert [r.o for r in rank.within_budget(items, ["k"], [F.col("o")], "size", 100).collect()] == [1]
    with pytest.raises(ValueError):
        rank.packet_order(spark, "LLLLL", 1, 1, 1, [1])


def test_text(spark):
    df = spark.createDataFrame([("a=1, cid = x7 ,b=2",), ("b=2",), (None,)], "h string")
    assert [r[0] for r in df.select(text.channel_id(F.col("h"))).collect()] == ["x7", None, None]
    v = spark.createDataFrame([("tool VERSION 2.5.0",), ("[INFO] Version: 1.4",), ("build 3.2.1 x",), ("none",)], "v string")
    assert [r[0] for r in v.select(text.version(F.col("v"))).collect()] == ["2.5.0", "1.4", "3.2.1", "unknown"]
    assert one(spark, text.xml_schema(F.lit("<gml:x>")), text.xml_schema(F.lit("<jpx/>")), text.xml_schema(F.lit("<a/>")))[:] == ("gml", "jpx", "generic")
    r = one(spark, text.timescale(F.lit(29.97)).alias("a"), text.timescale(F.lit(12.5)).alias("b"))
    assert (r.a[:], r.b[:]) == ((30000, 1001), (90000, 7200))
    n = one(spark, text.normalized(F.array(*map(F.lit, (1.0, 3.0, 2.0)))), text.normalized(F.array(F.lit(4.0), F.lit(4.0))))
    assert n[0] == [0.0, 1.0, 0.5] and n[1] == [0.5, 0.5]
    b = spark.createDataFrame([(bytearray(b"\x00\x01\x02\xff\x4f"),)], "d binary")
    assert b.select(text.big_endian(F.col("d"), 1, 2), text.big_endian(F.col("d"), 3, 2), text.big_endian(F.col("d"), 4, 2)).first()[:] == (258, 65359, None)


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert stats.component_statistics(empty, ["k"], F.col("v")).count() == 0
    r = stats.component_statistics(spark.createDataFrame([("a", None)], "k string, v double"), ["k"], F.col("v")).first()
    assert (r.n, r.mean, r.std) == (0, 0.0, 0.0)
    m = stats.error_metrics(spark.createDataFrame([("a", 1.0, 1.0)], "k string, a double, b double"), ["k"], F.col("a"), F.col("b"), 255, 0).first()
    assert (m.mse, m.psnr, m.within_tolerance) == (0.0, None, True)


@pytest.mark.parametrize("n", [2, 5, 8])
def test_long_lifting_equals_arrays_and_inverts(spark, n):
    lines = {k: [(k * 31 + 7 * i * i) % 101 - 50 for i in range(n)] for k in range(3)}
    df = spark.createDataFrame([(k, i, v) for k, s in lines.items() for i, v in enumerate(s)], "k int, i long, v long")
    long_ = lifting.forward53_long(df, ["k"], "i", "v")
    got = {}
    for r in long_.orderBy("k", "i").collect():
        got.setdefault(r.k, ([], []))
        got[r.k][0].append(r.low)
        got[r.k][1].append(r.high)
    for r in spark.createDataFrame([(k, s) for k, s in lines.items()], "k int, s array<bigint>").select("k", lifting.forward53(F.col("s")).alias("b")).collect():
        assert got[r.k][0] == r.b.low and [x for x in got[r.k][1] if x is not None] == r.b.high
    back = {(r.k, r.i): r.v for r in lifting.inverse53_long(long_, ["k"], "i").collect()}
    assert back == {(k, i): v for k, s in lines.items() for i, v in enumerate(s)}


def test_decomposition_keeps_the_number_of_cells(spark):
    df = spark.range(64).select((F.col("id") / 8).cast("long").alias("y"), (F.col("id") % 8).alias("x"), (F.col("id") * 37 % 50).alias("v"))
    rows = lifting.decompose53(df, [], ["x", "y"], "v", 2).collect()
    assert len(rows) == 64 and {(r.level, r.band) for r in rows} == {(1, "HL"), (1, "LH"), (1, "HH"), (2, "LL"), (2, "HL"), (2, "LH"), (2, "HH")}


def test_trellis_is_the_cheapest_path(spark):
    """Against a search over all paths of four states, of which odd ones add one to the level."""
    rng = random.Random(5)
    values, step = [round(rng.uniform(-9, 9), 3) for _ in range(200)] + [0.0, 2.5, -2.5], 1.7
    best = {s: (0.0, []) for s in range(4)}
    for c in values:
        new = {}
        for to in range(4):
            n = int(abs(c) // step) + to % 2
            cost = (abs(c) - n * step) ** 2 + 0.5 * (2 + math.log2(n + 1) if n else 1.0)
            new[to] = min(((best[s][0] + cost, [*best[s][1], n if c >= 0 else -n]) for s in range(4)), key=lambda x: x[0])
        best = new
    want = min(best.values(), key=lambda x: x[0])[1]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, c double")
    got = [r.q for r in rows.select("i", quantize.trellis(F.col("c"), F.lit(step)).alias("q")).orderBy("i").collect()]
    assert got == want
