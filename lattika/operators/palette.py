"""Palettes: the commonest colours, and each sample's entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def create_palette(df: DataFrame, r: str, g: str, b: str, most: int = 256) -> DataFrame:
    """idx, r, g, b of the ``most`` commonest colours, ties by colour: a bounded table."""
    if not 1 <= most <= 1024:
        raise ValueError("a palette has 1 to 1,024 colours")
    top = df.groupBy(F.col(r).alias("r"), F.col(g).alias("g"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "r", "g", "b").limit(most)
    return top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "r", "g", "b"))).alias("all")).select(F.posexplode("all").alias("idx", "c")).select(F.col("idx").cast("bigint").alias("idx"), "c.r", "c.g", "c.b")


def assign(df: DataFrame, palette: DataFrame, r: str, g: str, b: str) -> DataFrame:
    """df with idx: the nearest colour by squared distance, the first of equals; an exact match has distance 0.

    Distinct colours, not samples, are compared with the palette; it is bounded by create_palette, so it is broadcast as one array.
    """
    entries = F.broadcast(palette.agg(F.collect_list(F.struct("idx", "r", "g", "b")).alias("_p")))
    colours = df.select(F.col(r).alias("_r"), F.col(g).alias("_g"), F.col(b).alias("_b")).distinct().crossJoin(entries)
    d2 = lambda p: (p["r"] - F.col("_r")) * (p["r"] - F.col("_r")) + (p["g"] - F.col("_g")) * (p["g"] - F.col("_g")) + (p["b"] - F.col("_b")) * (p["b"] - F.col("_b"))
    near = colours.withColumn("_n", F.array_min(F.transform("_p", lambda p: F.struct(d2(p).alias("d2"), p["idx"].alias("idx"))))).select("_r", "_g", "_b", F.col("_n.idx").alias("idx"))
    return df.join(near, (df[r] == near["_r"]) & (df[g] == near["_g"]) & (df[b] == near["_b"])).drop("_r", "_g", "_b")


def expand(df: DataFrame, palette: DataFrame, idx: str) -> DataFrame:
    """df with r, g, b of its index. An index out of range raises."""
    rows = df.join(F.broadcast(palette.withColumnRenamed("idx", "_idx")), df[idx] == F.col("_idx"), "left")
    check = F.when(F.col("_idx").isNull() & F.col(idx).isNotNull(), F.raise_error(F.lit("palette index out of range"))).otherwise(F.col("r"))
    return rows.withColumn("r", check).drop("_idx")
