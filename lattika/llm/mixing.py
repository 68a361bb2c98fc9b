"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words. A document's expected copies are its source's target over its source's words:
the whole part is taken, and the fraction is rounded dependently. Two documents with open fractions trade words
at random until one fraction is 0 or 1, so the words of a source stay at the target all the way. Groups of bounded size
settle all but one document each; the documents left meet in a tree of such groups until a source has
one, which is rounded to the nearer side. A source's words thus miss its target by half a document at most.

Null text has size 0. Documents of size 0 are drawn one by one. A null source is a source, the last one. Repeated rows are
documents of their own, told apart by a number, so they fall into as many groups as other rows. An empty table gives an empty result. Draws follow from the seed and the rows alone, so
reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words, numbered

#: Documents that settle together at most, about; the tree's fan-in.
GROUP, FAN_IN = 4096, 64
#: Repeated rows that one task numbers at once.
COPIES = 65536


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """source, source_size, source_rows, rate (copies of a word) and target of each source.

    ``sizes`` has source and size. Sources by code point, null last, get the weights in turn and share all words; a target stops
    at ``most`` times its source's size, and the excess is shared again by weight. Only sums reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    per = numbered(per, [], ["source"], "_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    per = cut(per.withColumn("_w", w))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    share, held = None, F.lit(False)
    while True:  # each turn stops at least one more source
        got = per.agg(F.sum(F.when(held, most * F.col("source_size")).otherwise(0.0)).alias("full"), F.sum(F.when(~held, F.col("_w")).otherwise(0.0)).alias("w"), F.count(F.when(held, 1)).alias("n")).first()
        new = (total - (got["full"] or 0.0)) / got["w"] if got["w"] else 0.0
        if share is not None and new <= share:
            break
        share = new
        held = F.col("_w") * F.lit(share) >= most * F.col("source_size")
        if per.filter(held).count() == got["n"]:
            break
    target = F.when(held, most * F.col("source_size")).otherwise(F.col("_w") * F.lit(share))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    return per.select("source", "source_size", "source_rows", target.cast("double").alias("target"), rate.alias("rate"))


def settle(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Fractions after trades: all but one at most are 0 or 1, and the sum of size * p stays.

    Trades go along the order of the arrays; draws has a number in [0, 1) for each.
    """
    out, open_at = p.copy(), -1
    for i in range(len(p)):
        if not 0.0 < out[i] < 1.0:
            continue
        if size[i] == 0:
            out[i] = 1.0 if draws[i] < out[i] else 0.0
            continue
        if open_at < 0:
            open_at = i
            continue
        j, ratio = open_at, size[i] / size[open_at]
        a, b = min(1 - out[i], out[j] / ratio), min(out[i], (1 - out[j]) / ratio)
        if draws[i] * (a + b) < b:
            out[i], out[j] = (1.0 if a == 1 - out[i] else out[i] + a), (0.0 if a == out[j] / ratio else out[j] - a * ratio)
        else:
            out[i], out[j] = (0.0 if b == out[i] else out[i] - b), (1.0 if b == (1 - out[j]) / ratio else out[j] + b * ratio)
        for k in (i, j):
            if out[k] < 1e-12:
                out[k] = 0.0
            elif out[k] > 1 - 1e-12:
                out[k] = 1.0
        open_at = i if 0.0 < out[i] < 1.0 else j if 0.0 < out[j] < 1.0 else -1
    return out


def _settle_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "_draw", "doc_id"], ascending=[False, True, True], kind="stable")
    rows["_p"] = settle(rows["size"].to_numpy(float), rows["_p"].to_numpy(float), rows["_draw"].to_numpy(float))
    return rows


def apart(rows: DataFrame) -> DataFrame:
    """``rows`` with the column _copy: 0, 1, ... among rows equal in every column. Equal rows are counted and laid out again in blocks, so no task gets all of a row's copies."""
    names = rows.columns
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    blocks = cut(counts.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES))).alias("_block")))
    many = F.col("_n") > COPIES
    spread = blocks.filter(~many).unionByName(blocks.filter(many).repartition(*names, "_block"))
    first = F.col("_block") * COPIES
    return spread.select(*names, F.explode(F.sequence(first, F.least(first + COPIES, F.col("_n")) - 1)).alias("_copy"))


def fractions(sized: DataFrame, per: DataFrame, seed: int = 0) -> DataFrame:
    """``sized`` (doc_id, source, size, text_key) with its source's figures, whole copies, the fraction _p, a draw and the rounding group _bucket."""
    # one row for each source: Spark broadcasts it below its threshold and shuffles beyond
    rows = apart(sized).join(per.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole, key = F.floor("rate"), ["doc_id", "text_key", "_copy"]
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) * F.lit(2.0**-53)
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.ceil(F.col("source_rows") / GROUP))
    return rows.withColumns({"_whole": whole, "_p": F.col("rate") - whole, "_draw": unit, "_bucket": bucket, "_has": F.col("source").isNotNull()}).drop("rate", "_copy")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 0) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, copies and taken of each row of ``docs`` (doc_id, text, source).

    text_key is xxhash64 of the text. Sizes alone travel, never texts.
    """
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key")))
    per = source_targets(sized, weights, most)
    rows = fractions(sized, per, seed)
    open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
    done, left = rows.filter(~open_), rows.filter(open_)
    most_buckets = -(-(per.agg(F.max("source_rows")).first()[0] or 0) // GROUP)
    while True:
        settled = cut(left.groupBy("source", "_has", "_bucket").applyInPandas(_settle_group, left.schema))
        done, left = done.unionByName(settled.filter(~open_)), settled.filter(open_)
        if most_buckets <= 1:
            break
        most_buckets = -(-most_buckets // FAN_IN)
        left = left.withColumn("_bucket", F.floor(F.col("_bucket") / FAN_IN)).withColumn("_draw", F.pmod(F.col("_draw") * 1048583.0, F.lit(1.0)))
    done = done.unionByName(left.withColumn("_p", F.when(F.col("_p") >= 0.5, 1.0).otherwise(0.0)))
    copies = (F.col("_whole") + F.col("_p")).cast("long")
    return done.select("doc_id", "text_key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows equal in doc_id, text and source share their copies evenly."""
    totals = mix_sources(docs, **options).groupBy("doc_id", "text_key", "source").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_n"))
    totals = cut(totals.withColumnsRenamed({"doc_id": "_id", "source": "_src", "text_key": "_tk"}))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_own"), F.col("source").alias("_from"), F.xxhash64("text").alias("_key"))
    rows = keyed.join(totals, (F.col("_key") == F.col("_tk")) & F.col("_own").eqNullSafe(F.col("_id")) & F.col("_from").eqNullSafe(F.col("_src")))
    once = rows.filter("_n = 1").withColumn("_each", F.col("_copies"))
    same = ["_id", "_tk", "_src"]
    again = numbered(rows.filter("_n > 1"), [], same, "_g")
    first = again.groupBy(*same).agg(F.min("_g").alias("_g0")).withColumnsRenamed({c: f"{c}2" for c in same})
    again = again.join(first, F.col("_tk").eqNullSafe(F.col("_tk2")) & F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_src").eqNullSafe(F.col("_src2")))
    again = again.withColumn("_each", F.floor(F.col("_copies") / F.col("_n")) + F.when(F.col("_g") - F.col("_g0") < F.col("_copies") % F.col("_n"), 1).otherwise(0))
    both = once.select("_row", "_each").unionByName(again.select("_row", "_each"))
    return both.filter("_each > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_each").cast("int")))).select("_row.*")


def targets_sql() -> str:
    """DuckDB SQL for doc_id, size, source_size and target (6 places) over documents: sources that stop are those with the least size by weight."""
    return r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
p AS (SELECT source, sum(size)::DOUBLE AS z, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * z / w AS r, row_number() OVER (ORDER BY 3 * z / w, source NULLS LAST) AS i, sum(z) OVER () AS t, sum(w) OVER () AS all_w FROM p),
k AS (SELECT *, (t - 3 * coalesce(sum(z) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS share FROM o WINDOW b AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT coalesce((SELECT share FROM k WHERE share <= r ORDER BY i LIMIT 1), 1e300) AS share)
SELECT doc_id, size, z::BIGINT AS source_size, round(least(w * s.share, 3 * z), 6) AS target FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, s
"""
