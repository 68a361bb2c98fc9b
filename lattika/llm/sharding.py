"""Rendezvous hashing of record keys over weighted shards.

Each shard scores a key by ``-weight / ln(u)``, u in (0, 1) from the MD5 of key and shard number, and the highest score takes it. A new shard only
takes keys that it now scores highest; no key moves between old shards. Everything is a column expression.
A null key is a key like any other. Equal keys share a shard; slots tell them apart. Shard files keep every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, numbered

LAW = "key"


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, of a key."""
    def score(i: int, w: float) -> Column:
        digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(i))).cast("binary"))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) * F.lit(2.0**-52)
        return F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(-i).alias("minus"))

    return (-F.array_max(F.array(*[score(i, w) for i, w in enumerate(weights)]))["minus"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """df with shard, and grown_shard: the shard under the weights ``grown``, by default one more of the mean weight. Columns that had these names end in an underscore."""
    grown = grown or [*weights, sum(weights) / len(weights)]
    rows = aside(df, ["shard", "grown_shard"])
    of = F.col(rows.columns[df.columns.index(key)])
    return rows.withColumns({"shard": shard_of(of, weights), "grown_shard": shard_of(of, grown)})


def shard_digest(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of ``docs``.

    Null text counts as empty. Slots follow doc_id, null last; numbering is distributed, so a shard never meets in one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign_shards(rows, "doc_id", [1.0] * n_shards)
    rows = numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC of a text's bytes: the polynomial is linear, so a byte's remainder is the sum of its bits'."""
    of_bit = []
    for bit in range(8):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        of_bit.append(c)
    step = "c >> 8"
    for bit, r in enumerate(of_bit):
        step = f"xor({step}, ((xor(c, b) >> {bit}) & 1) * {r}::BIGINT)"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}), 4294967295::BIGINT)"


def digest_sql(n_shards: int = 16) -> str:
    """DuckDB SQL for shard_digest over documents: with equal weights the greatest hash has the highest score."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_transform(range({n_shards + 1}), lambda i: ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT) AS u FROM documents),
s AS (SELECT doc_id, strlen(t) + 1 AS size, {crc32_sql("t")} AS text_crc32, (list_position(u[1:{n_shards}], list_max(u[1:{n_shards}])) - 1)::INTEGER AS shard, (list_position(u, list_max(u)) - 1)::INTEGER AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, '{LAW}' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""


def write_shards(df: DataFrame, key: str, weights: list[float], path: str, files: int = 4) -> None:
    """Parquet below path/shard=N, all columns (one that was named shard ends in an underscore); ``files`` files a shard, by a second hash, so that a large shard isn't one task."""
    rows = aside(df, ["shard"])
    deal = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
    rows = rows.withColumn("shard", shard_of(F.col(rows.columns[df.columns.index(key)]), weights))
    rows.repartition(len(weights) * files, "shard", deal).write.partitionBy("shard").parquet(path)
