"""Regions and tiles in the transform domain against plain versions."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lattika.operators import lifting, transform_domain
from lattika.operators.transform_domain import Region


def grid(spark, width, height, seed=1):
    rnd = random.Random(seed)
    rows = [("i", y, x, rnd.randrange(-500, 500)) for y in range(height) for x in range(width)]
    return rows, spark.createDataFrame(rows, "img string, y long, x long, v long")


def test_band_masks_and_feather(spark):
    rows, df = grid(spark, 11, 7)
    mask = {(y, x): v > 440 for _, y, x, v in rows}
    got = transform_domain.band_masks(df, ["img"], 2, {"m": F.when(F.col("v") > 440, True)}).collect()  # null elsewhere
    for r in got:
        s = 1 << r.level
        x0, y0 = r.x * s + (s // 2 if r.band[0] == "H" else 0), r.y * s + (s // 2 if r.band[1] == "H" else 0)
        assert r.m == any(mask.get((y, x), False) for y in range(y0, y0 + s // 2) for x in range(x0, x0 + s // 2)), r
    assert {r.band for r in got if r.level == 1} == {"HL", "LH", "HH"} and "LL" in {r.band for r in got if r.level == 2}
    places = df.withColumn("m", F.col("v") > 440)
    for width in (0, 1, 3):
        for r in transform_domain.feathered(places, ["img"], "m", width, "f").collect():
            near = min((math.dist((r.y, r.x), p) for p, on in mask.items() if on), default=99.0)
            assert abs(r.f - (1.0 if near == 0 else max(0.0, 1 - near / width) if width else 0.0)) < 1e-12


def test_scaling_modes(spark):
    _, df = grid(spark, 4, 4)
    whole = F.lit(True)
    scale = lambda *rs: {r.scale for r in transform_domain.scaling_map(df, ["img"], 1, list(rs)).collect()}
    two, half = Region(whole, 2.0), lambda mode, p=1: Region(whole, 0.5, mode=mode, priority=p)
    assert scale(two, half("maximum")) == {2.0} and scale(two, half("minimum")) == {0.5} and scale(two, half("average")) == {1.25}
    assert scale(two, half("weighted", 5)) == {1.25} and scale(two, half("priority")) == {2.0} and scale(two, half("priority", 2)) == {0.5}
    assert scale() == {1.0} and transform_domain.scaling_map(df.filter("false"), ["img"], 1, [two]).count() == 0


def test_coefficients_are_cut_off(spark):
    _, df = grid(spark, 6, 5)
    bands = lifting.decompose53(df, ["img"], ["x", "y"], "v", 2)
    before = {(r.level, r.band, r.y, r.x): r.v for r in bands.collect()}
    got = transform_domain.scale_coefficients(bands, transform_domain.scaling_map(df, ["img"], 2, [Region(F.col("x") < 2, 1.5)]), ["img"]).collect()
    changed = [r for r in got if r.v != before[r.level, r.band, r.y, r.x]]
    assert len(got) == len(before) == 30 and changed and all(r.v == math.trunc(1.5 * before[r.level, r.band, r.y, r.x]) for r in changed)


def test_tiles(spark, tmp_path):
    rows, df = grid(spark, 13, 9)
    across = F.lit(3)
    bands = transform_domain.decompose_tiles(df, ["img"], "v", 2, 5, 4, across).cache()
    alone = df.filter("x >= 10 and y >= 8").select("img", (F.col("y") - 8).alias("y"), (F.col("x") - 10).alias("x"), "v")  # the last tile: 3 by 1
    want = lifting.decompose53(alone, ["img"], ["x", "y"], "v", 2).collect()
    own = bands.filter("tile = 8").select("img", "level", "band", "y", "x", "v").collect()
    assert Counter(map(tuple, own)) == Counter(map(tuple, want)) and len(own) == 3
    back = transform_domain.recompose_tiles(bands, ["img"], 2, 5, 4, across).collect()
    assert Counter((r.img, r.y, r.x, r.v) for r in back) == Counter(rows)
    path = str(tmp_path / "tiles")
    transform_domain.write_tiles(bands, path)
    read = spark.read.parquet(path).filter("tile in (0, 1)")
    assert read.count() == bands.filter("tile in (0, 1)").count() == 40
