"""Token buckets in two levels: one for all clients, then each client's own.

A bucket holds up to twice its rate, is full at first, and refills by its rate; a request takes its bytes if they are there. Were every request served, the level after it
would be a running sum against a running maximum, both found by slots. Where that level touches the brim the bucket is surely full, whatever was refused before:
there a new stretch begins. A stretch whose level never falls below 0 refuses nothing. Only in the others do refusals feed back, and their rows are
folded in order, each stretch for itself, with one number carried from row to row; a stretch lasts as long as the bucket is overdrawn and does not recover.
A request of more bytes than the bucket holds is refused whatever came before and takes nothing, so it is told apart first and overdraws no bucket.

Refills are whole tokens of the time since the epoch, so no fraction of a token is lost between requests. A request that its client's bucket refuses has taken its
bytes from the common one. Null bytes count as 0; rows that tie in the order run in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slots import join_same
from .staging import staged


def take(requests: DataFrame, keys: list[str], at: str, order: list[str], size: str, rate: int, name: str, slot_seconds: int = 60) -> DataFrame:
    """requests with ``name``: whether the bucket of its keys (one for all without any) has served it. ``at`` is a timestamp, ``order`` tells its ties apart."""
    cap = 2 * rate
    us = F.unix_micros(F.col(at).cast("timestamp"))
    refill = F.floor(us / 1_000_000) * rate + F.floor(F.pmod(us, F.lit(1_000_000)) * rate / 1_000_000)
    rows = requests.withColumns({"_us": us, "_r": refill.cast("long"), "_s": F.coalesce(F.col(size), F.lit(0)).cast("long")})
    never = rows.filter(F.col("_s") > cap).withColumn(name, F.lit(False)).drop("_us", "_r", "_s")
    rows = rows.filter(F.col("_s") <= cap).withColumn("_slot", F.floor(F.col("_us") / (slot_seconds * 1_000_000)))
    by = [F.col("_us"), *map(F.col, order)]
    w = Window.partitionBy(*keys, "_slot").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    # a slot is a pair: what it takes, and the greatest of refills less what was taken before; pairs join from slot to slot
    rows = rows.withColumn("_sum", F.sum("_s").over(w)).withColumn("_top", F.max(F.col("_r") - F.col("_sum") + F.col("_s")).over(w))
    slots = rows.groupBy(*keys, "_slot").agg(F.sum("_s").alias("_taken"), F.max("_top").alias("_most"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_off", F.coalesce(F.sum("_taken").over(before), F.lit(0)))
    slots = slots.withColumn("_brim", F.max(F.col("_most") - F.col("_off")).over(before)).select(*keys, "_slot", "_off", "_brim")
    rows = join_same(rows, slots, [*keys, "_slot"])
    rows = rows.withColumn("_stretch", F.greatest(F.col("_top") - F.col("_off"), F.col("_brim")))
    rows = rows.withColumn("_level", F.col("_r") - F.col("_sum") - F.col("_off") - F.col("_stretch") + cap)
    rows = staged(rows.drop("_slot", "_sum", "_top", "_off", "_brim"))
    short = rows.groupBy(*keys, "_stretch").agg(F.min("_level").alias("_least")).filter("_least < 0")
    rows = join_same(rows.drop("_level"), short, [*keys, "_stretch"])
    served = rows.filter("_least is null").withColumn(name, F.lit(True))
    schema = served.schema

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, tokens, last = None, cap, 0
        for frame in frames:
            out = []
            own = zip(*[frame[c].astype(object).where(frame[c].notna(), None) for c in [*keys, "_stretch"]], strict=True)
            for key, r, s in zip(own, frame["_r"].tolist(), frame["_s"].tolist(), strict=True):
                if key != stretch:
                    stretch, tokens, last = key, cap, r
                tokens, last = min(cap, tokens + r - last), r
                out.append(tokens >= s)
                if tokens >= s:
                    tokens -= s
            yield frame.assign(**{name: out})

    again = rows.filter("_least is not null").repartition(*map(F.col, [*keys, "_stretch"])).sortWithinPartitions(*keys, "_stretch", *by)
    return served.unionByName(again.mapInPandas(fold, schema)).drop("_us", "_r", "_s", "_stretch", "_least").unionByName(never)


def throttle(requests: DataFrame, client: str, at: str, order: list[str], size: str, common_rate: int, client_rate: int) -> DataFrame:
    """requests with ``verdict``: sent, common (the bucket of all refused it) or client (its own did)."""
    rows = take(requests, [], at, order, size, common_rate, "_common")
    own = take(rows.filter("_common"), [client], at, order, size, client_rate, "_own")
    refused = rows.filter(~F.col("_common")).withColumn("_own", F.lit(None).cast("boolean"))
    return own.unionByName(refused).withColumn("verdict", F.when(~F.col("_common"), "common").when(~F.col("_own"), "client").otherwise("sent")).drop("_common", "_own")


def throttle_report(verdicts: DataFrame, client: str, size: str) -> DataFrame:
    """bytes_sent, refused by the common bucket, refused by clients' own, and clients that have a bucket."""
    v: Column = F.col("verdict")
    return verdicts.agg(F.coalesce(F.sum(F.when(v == "sent", F.col(size))), F.lit(0)).alias("bytes_sent"), F.count(F.when(v == "common", 1)).alias("common_refusals"), F.count(F.when(v == "client", 1)).alias("client_refusals"), F.count_distinct(F.when(v != "common", F.col(client))).alias("clients"))
