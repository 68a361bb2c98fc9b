"""Grid measures: structural similarity, edge density and frequency content. Grids are long: keys, y, x, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the five scales.
SCALE_WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def window_ids(at: Column, extent: int, size: int = 8, stride: int = 4) -> Column:
    """Windows along an axis that a position is in; starts are 0, stride, ... below extent - size."""
    starts = [s for s in range(0, extent - size, stride)]
    if not starts:
        return F.array().cast("array<int>")
    return F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: (s <= at) & (at < s + size))


def ssim(df: DataFrame, keys: list[str], width: int, height: int, peak: float, a: str = "a", b: str = "b") -> DataFrame:
    """ssim of each key: the mean over 8 x 8 windows of stride 4, 0 without windows. A pixel goes to four windows at most, whose moments are partial sums."""
    rows = df.withColumn("_wy", F.explode(window_ids(F.col("y"), height))).withColumn("_wx", F.explode(window_ids(F.col("x"), width)))
    m = rows.groupBy(*keys, "_wy", "_wx").agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(F.col(a) * F.col(a)).alias("aa"), F.avg(F.col(b) * F.col(b)).alias("bb"), F.avg(F.col(a) * F.col(b)).alias("ab"))
    va, vb, cov = F.greatest(F.lit(0.0), F.col("aa") - F.col("ma") * F.col("ma")), F.greatest(F.lit(0.0), F.col("bb") - F.col("mb") * F.col("mb")), F.col("ab") - F.col("ma") * F.col("mb")
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    value = ((2 * F.col("ma") * F.col("mb") + c1) * (2 * cov + c2)) / ((F.col("ma") * F.col("ma") + F.col("mb") * F.col("mb") + c1) * (va + vb + c2))
    return m.select(*keys, value.alias("_v")).groupBy(*keys).agg(F.avg("_v").alias("ssim"))


def halve(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The grid at half size: means of 2 x 2 blocks, down to whole numbers."""
    return df.groupBy(*keys, F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(*[F.floor(F.avg(v)).cast("double").alias(v) for v in values])


def edge_density(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean gradient magnitude over inner cells over 500, 1 at most.

    Each cell gives its share to its eight neighbours, so one aggregation replaces two passes of lags.
    """
    moves = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    weight = {-1: 1, 0: 2, 1: 1}
    sent = F.explode(F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), (F.col(value) * (dx * weight[dy])).alias("gx"), (F.col(value) * (dy * weight[dx])).alias("gy")) for dy, dx in moves]))
    cells = df.select(*keys, sent.alias("_s")).groupBy(*keys, "_s.y", "_s.x").agg(F.sum("_s.gx").alias("gx"), F.sum("_s.gy").alias("gy"), F.count(F.lit(1)).alias("n")).filter("n = 9")
    return cells.groupBy(*keys).agg(F.least(F.lit(1.0), F.avg(F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))) / 500.0).alias("edge_density"))


def frequency_content(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Detail energy over total energy of one 2 x 2 averaging level, 0 for an empty total. Grids of even sides."""
    pick = lambda dy, dx: F.sum(F.when((F.col("y") % 2 == dy) & (F.col("x") % 2 == dx), F.col(value)).otherwise(0.0))
    q = df.groupBy(*keys, F.floor(F.col("y") / 2).alias("_y"), F.floor(F.col("x") / 2).alias("_x")).agg(pick(0, 0).alias("_a"), pick(0, 1).alias("_b"), pick(1, 0).alias("_c"), pick(1, 1).alias("_d"))
    a, b, c, d = (F.col(f"_{k}") for k in "abcd")
    ll, lh, hl, hh = (a + b + c + d) / 4, (a + b - c - d) / 4, (a - b + c - d) / 4, (a - b - c + d) / 4
    sums = q.groupBy(*keys).agg(F.sum(ll * ll).alias("_low"), F.sum(lh * lh + hl * hl + hh * hh).alias("_high"))
    return sums.select(*keys, F.coalesce(F.try_divide(F.col("_high"), F.col("_low") + F.col("_high")), F.lit(0.0)).alias("frequency_content"))


# Texture above which blocks have sides 16 and 32.
BLOCK_THRESHOLDS = {"conservative": (0.7, 0.4), "balanced": (0.5, 0.25), "aggressive": (0.3, 0.15)}


def texture(edge: Column, frequency: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 * edge + 0.6 * frequency)


def block_size(texture_: Column, mode: str = "balanced") -> Column:
    """Code block side for a texture measure: busier regions get smaller blocks."""
    high, medium = BLOCK_THRESHOLDS[mode]
    return F.when(texture_ > high, 16).when(texture_ > medium, 32).otherwise(64)


def multiscale_ssim(df: DataFrame, keys: list[str], width: int, height: int, peak: float, scales: int = 5, a: str = "a", b: str = "b") -> DataFrame:
    """Product over scales of SSIM to the scale's weight; grids are halved, in whole numbers, between scales. A negative SSIM has no power: null."""
    if not 1 <= scales <= len(SCALE_WEIGHTS):
        raise ValueError("1 to 5 scales")
    out, grid = None, df
    for k in range(scales):
        one = ssim(grid, keys, width, height, peak, a, b).withColumn("ssim", F.when(F.col("ssim") >= 0, F.pow("ssim", F.lit(SCALE_WEIGHTS[k]))))
        out = one if out is None else out.join(one.withColumnRenamed("ssim", "_s"), keys).withColumn("ssim", F.col("ssim") * F.col("_s")).drop("_s")
        grid = halve(grid, keys, [a, b])
        width, height = width // 2, height // 2
    return out


def image_psnr(df: DataFrame, image: list[str], component: str, a: str, b: str, peak: float) -> DataFrame:
    """psnr of each image, from the mean of its components' mean squared errors; null for a perfect match."""
    d = F.col(a) - F.col(b)
    per = df.groupBy(*image, component).agg(F.avg(d * d).alias("_m")).groupBy(*image).agg(F.avg("_m").alias("mse"))
    return per.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(F.lit(float(peak) ** 2) / F.col("mse"))))


def busy_blocks(df: DataFrame, keys: list[str], value: str, width: int, height: int, block: int = 32, threshold: float = 0.5, least: int = 100) -> DataFrame:
    """Blocks whose mean gradient over 255 is above the threshold: x, y, width, height, scale and priority of a region each.

    A cell's gradient is from central differences, 0 at the border; each cell sends its share to its four neighbours.
    """
    inner = (F.col("y") > 0) & (F.col("y") < height - 1) & (F.col("x") > 0) & (F.col("x") < width - 1)
    sent = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), (F.col(value) * -dx).alias("gx"), (F.col(value) * -dy).alias("gy")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    cells = df.select(*keys, F.explode(sent).alias("_s")).groupBy(*keys, "_s.y", "_s.x").agg(F.sum("_s.gx").alias("gx"), F.sum("_s.gy").alias("gy")).filter(inner)
    edge = F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))
    by, bx = F.floor(F.col("y") / block) * block, F.floor(F.col("x") / block) * block
    sums = cells.groupBy(*keys, by.alias("y"), bx.alias("x")).agg(F.sum(edge).alias("_e"))
    w, h = F.least(F.lit(block), width - F.col("x")), F.least(F.lit(block), height - F.col("y"))
    out = sums.withColumns({"width": w, "height": h}).withColumn("_n", F.col("_e") / (F.col("width") * F.col("height")) / 255.0)
    return out.filter((F.col("_n") > threshold) & (F.col("width") * F.col("height") >= least)).select(*keys, "x", "y", "width", "height", (1 + F.col("_n")).alias("scale"), F.floor(F.col("_n") * 10).alias("priority"))


def local_moments(df: DataFrame, keys: list[str], value: str, reach: int) -> DataFrame:
    """y, x, mean and variance over the cells within ``reach`` along both axes, by two passes of windows over sums: rows, then columns."""
    from pyspark.sql import Window

    across = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-reach, reach)
    down = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-reach, reach)
    v = F.col(value).cast("double")
    rows = df.select(*keys, "y", "x", F.sum(v).over(across).alias("_s"), F.sum(v * v).over(across).alias("_q"), F.count(v).over(across).alias("_n"))
    sums = rows.select(*keys, "y", "x", *[F.sum(c).over(down).alias(c) for c in ("_s", "_q", "_n")])
    mean = F.col("_s") / F.col("_n")
    return sums.select(*keys, "y", "x", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean).alias("variance"))
