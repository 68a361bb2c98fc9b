"""Importance resampling towards a target: documents drawn by hashed n-gram log-ratios and Gumbel noise.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z alone; features are all runs of 1 to 3 words, joined by one space, repeats
counted, and a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.

Texts of a partition are taken in blocks. A block's words become ids, and its suffixes are sorted by their first three ids: a suffix array of depth
three. Neighbours' common prefixes cut the array into runs of one n-gram each, for each n. An n-gram is hashed once a run, by combining its words' remainders,
and the bucket is scattered back to the run's places in the texts. A block has ``BLOCK_WORDS`` suffixes at most, and two more words to look at, so that
a text of any length needs no larger sort.

Bucket counts of the corpus and of the target are sums over all texts; a task sends one row a bucket at most, and the ``BUCKETS`` gains alone reach
the driver. Null text has no words. Documents below the least number of words are scored, not drawn. A null doc_id draws with the text ``null`` and comes last among ties.
Repeated rows are documents of their own. Empty tables give an empty result, an empty target counts as zeros. Other columns of the documents don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, byte_table, cut, numbered, slices, small_batches

#: Buckets of features, suffixes in a block, words in the longest feature.
BUCKETS, BLOCK_WORDS, MOST = 10000, 1 << 19, 3
#: Documents with fewer words are not drawn; share drawn of the others, in percent.
LEAST_WORDS, PERCENT = 20, 5

_TABLE = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ---- remainders -----------------------------------------------------------------------------------------------------

#: Longest word, and the space before it, whose remainder is combined from tables; longer ones are hashed from their bytes.
_TABLED = 64


def _shift_tables() -> np.ndarray:
    """[k][j][b]: what byte j with the value b of a remainder becomes when k zero bytes follow."""
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    out = np.empty((_TABLED + 1, 4, 256), np.uint32)
    for j in range(4):
        out[0, j] = byte << np.uint32(8 * j)
    for k in range(1, _TABLED + 1):
        out[k] = out[k - 1] >> np.uint32(8) ^ one[out[k - 1] & 255]
    return out


_SHIFT = _shift_tables()


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put together, from those of their parts and the length of the right one (``_TABLED`` at most)."""
    out = right.copy()
    for j in range(4):
        out ^= _SHIFT[length, j, left >> np.uint32(8 * j) & np.uint32(255)]
    return out


# ---- a block's suffixes ---------------------------------------------------------------------------------------------


def suffix_array(ids: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the first n suffixes by their first ``MOST`` words, and the common prefix of each with the one before it.

    ``ends`` is each word's text's end: a suffix ends there. ids start from 1; a common prefix never counts what lies beyond an end.
    """
    at = np.arange(n)
    columns = []
    for k in range(MOST):
        inside = at + k < ends[:n]
        columns.append(np.where(inside, ids[np.minimum(at + k, len(ids) - 1)], 0))
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if bits * MOST <= 64:
        key = columns[0].astype(np.uint64)
        for c in columns[1:]:
            key = key << np.uint64(bits) | c.astype(np.uint64)
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    common, same = np.zeros(n, np.int8), np.ones(n, bool)
    same[:1] = False
    for c in columns:
        own = c[order]
        same[1:] &= (own[1:] == own[:-1]) & (own[1:] > 0)
        common += same
    return order, common


def block_buckets(ids: np.ndarray, ends: np.ndarray, n: int, words: list[bytes], crc: np.ndarray, length: np.ndarray, buckets: int) -> np.ndarray:
    """[k, i]: bucket of the feature of k + 1 words that starts at word i of the first n; -1 where the text ends before."""
    order, common = suffix_array(ids, ends, n)
    out = np.full((MOST, n), -1, np.int32)
    space = np.uint32(zlib.crc32(b" "))
    for k in range(MOST):
        whole = order + k < ends[order]
        head = common <= k  # a run of features of k + 1 words begins
        first = order[head & whole]
        if not len(first):
            break
        total = crc[ids[first]]
        for j in range(1, k + 1):
            nxt = ids[first + j]
            # one space, then the word
            spaced = joined_crc(total, np.full(len(total), space, np.uint32), np.ones(len(total), np.int64))
            size = length[nxt]
            total = joined_crc(spaced, crc[nxt], np.minimum(size, _TABLED))
            for i in np.flatnonzero(size > _TABLED).tolist():
                total[i] = zlib.crc32(words[nxt[i]], int(spaced[i]))
        bucket = (total % np.uint32(buckets)).astype(np.int32)
        run = np.cumsum(head & whole) - 1
        out[k, order[whole]] = bucket[run[whole]]
    return out


def text_buckets(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every feature of the texts, block by block."""
    texts = [t.translate(_LOWER) for t in texts]
    words = Words(texts, _TABLE)
    total = len(words.hash)
    ends = np.repeat(words.at[1:], np.diff(words.at))
    text = words.text_of()
    joined = b" ".join([*texts, b""])
    for a in range(0, total, BLOCK_WORDS):
        b = min(total, a + BLOCK_WORDS)
        upto = min(total, b + MOST - 1)
        _, first, ids = np.unique(words.hash[a:upto], return_index=True, return_inverse=True)
        spelled = [b""] + [joined[s:e] for s, e in zip(words.start[a:upto][first].tolist(), words.end[a:upto][first].tolist(), strict=True)]
        crc = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(spelled))
        length = np.fromiter(map(len, spelled), np.int64, len(spelled))
        got = block_buckets(ids + 1, ends[a:upto] - a, b - a, spelled, crc, length, buckets)
        for row in got:
            ok = row >= 0
            yield text[a:b][ok], row[ok]


# ---- the operator ---------------------------------------------------------------------------------------------------


def bucket_counts(df: DataFrame, column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of all texts fall into each bucket that any falls into."""
    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in slices(texts, 4 << 20):
                for _, bucket in text_buckets(texts[a:b], buckets):
                    n += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["bucket", "n"])

    return df.select(F.col(column).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: floor of 1000 times the log-ratio of its smoothed shares in the target and in the corpus."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, df in ((s, docs), (t, target)):
        for r in bucket_counts(df, "text", buckets).collect():  # a row a bucket at most
            counts[r["bucket"]] = r["n"]
    ratio = (t + 1.0) * (float(s.sum()) + buckets) / ((s + 1.0) * (float(t.sum()) + buckets))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (sum of the features' gains) of each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # len(gains) numbers, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            texts = as_bytes(batch.column(1))
            singles, n, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for a, b in slices(texts, 4 << 20):
                for k, (text, bucket) in enumerate(text_buckets(texts[a:b], len(gain))):
                    size = np.bincount(text, minlength=b - a)
                    n[a:b] += size
                    if k % MOST == 0:
                        singles[a:b] += size
                    high, low = gain[bucket] >> 10, gain[bucket] & 1023  # exact sums in doubles
                    weight[a:b] += np.bincount(text, high, b - a).astype(np.int64) * 1024 + np.bincount(text, low, b - a).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(singles), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (1, 2, ... of the documents drawn, else null) of each row of ``docs``.

    Of the N documents with enough words the floor(percent * N / 100) with the highest scores are drawn, ties to the smaller doc_id.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = cut(weigh(docs, bucket_gains(docs, target, buckets)).withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    n = scored.filter(able).count() * percent // 100
    ranked = numbered(scored.filter(able).withColumn("_minus", -F.col("score")), [], ["_minus", "doc_id"], "_n").drop("_minus")
    ranked = ranked.withColumn("rank", F.when(F.col("_n") < n, F.col("_n") + 1)).drop("_n")
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns; doc_id must tell the rows apart."""
    drawn = resample(docs, target, **options).filter(F.col("rank").isNotNull()).select("doc_id")
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["doc_id"]), "left_semi")


def resample_sql() -> str:
    """DuckDB SQL for doc_id, n_features, weight, score and rank over documents and benchmark."""
    from .sharding import crc32_sql

    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bench AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (SELECT r, array_to_string(w[i : i + k - 1], ' ') AS f FROM docs, (VALUES (1), (2), (3)) AS n(k), unnest(range(1, len(w) + 2 - k)) AS u(i)),
goals AS (SELECT array_to_string(w[i : i + k - 1], ' ') AS f FROM bench, (VALUES (1), (2), (3)) AS n(k), unnest(range(1, len(w) + 2 - k)) AS u(i)),
own AS (SELECT r, f, count(*) AS n FROM runs GROUP BY r, f),
named AS (SELECT f, {crc32_sql("f")} % 10000 AS b FROM (SELECT f FROM own UNION SELECT f FROM goals)),
s AS (SELECT b, sum(n) AS s FROM own JOIN named USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM goals JOIN named USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (b)),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM own JOIN named USING (f) JOIN g USING (b) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM docs LEFT JOIN weighed USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 5 * n // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
