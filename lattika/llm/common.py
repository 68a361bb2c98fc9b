"""Helpers shared by the training-data operators: shared folders, numbering, and words as numpy arrays.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]`` everywhere in this subpackage unless an operator says otherwise.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and DuckDB regular expression of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch that goes to Python: long documents must not pile up in one batch.
ARROW_ROWS = 500

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share: ``spark.checkpoint.dir``, on the file system that Spark itself resolves it on.

    Where that is unset, the context's checkpoint folder, or, on a local master alone, one of this machine. A cluster without either is an error.
    """
    sc = spark.sparkContext
    at, own = spark.conf.get("spark.checkpoint.dir", None), sc._jsc.sc().getCheckpointDir()
    if at is None and own.isDefined():
        at = own.get()
    if at is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file:///tmp/checkpoints"
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    return re.sub(r"^file:/(?!//)", "file:///", path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/"))


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder's URI below the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written as a table in the shared folder; its lineage ends there, and sizes are known to the planner."""
    at = work_dir(df.sparkSession, "table")
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once nothing reads them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def sift(rows: DataFrame, columns: list[str], keys: DataFrame, name: str, most_bits: int = 1 << 27) -> DataFrame:
    """rows with the column ``name``: false only where their ``columns`` are surely not among ``keys``; nothing moves.

    A bitmap with 16 bits or more a key is broadcast. It has 16 MB at most: with very many keys it tells fewer foreign rows, down to none.
    A join with the keys must follow for the rows that are true.
    """
    bits = 1 << 15
    n = keys.count()
    while bits < 16 * n and bits < most_bits:
        bits *= 2
    slot = (F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1).alias("_slot")
    maps = keys.select(slot).groupBy(F.bitmap_bucket_number("_slot").alias("_map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    at = F.bitmap_bit_position("_slot").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_slot", slot).withColumn("_map", F.bitmap_bucket_number("_slot")).join(F.broadcast(maps), "_map", "left")
    hit = F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1
    return marked.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(name))


def sieve(rows: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """The rows that may be among ``keys`` by ``sift``."""
    return sift(rows, columns, keys, "_may").filter("_may").drop("_may")


def join_hot(rows: DataFrame, key: str, right: DataFrame, share: int = 1024) -> DataFrame:
    """``rows`` left-joined to ``right``, which has one row a key at most, by the column ``key``, where few keys may hold most rows.

    Keys with more than one in ``share`` of all rows are fewer than ``share``, so their rows of ``right`` are broadcast; the rest
    meet in a shuffle where no key is large. Null keys match nothing and move nowhere. Both sides are read more than once: cut them first.
    """
    hot = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * share > rows.count()).select(key)
    hot = F.broadcast(cut(hot))
    near = rows.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, "left")
    far = rows.filter(F.col(key).isNotNull()).join(hot, key, "left_anti").join(right, key, "left")
    none = rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key])
    return near.unionByName(far).unionByName(none)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the documents that one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def aside(df: DataFrame, names: list[str]) -> DataFrame:
    """df with its columns of these names, in either case, under names of their own: with underscores at the end. Results may then take the names."""
    taken, new = {c.lower() for c in df.columns} | {n.lower() for n in names}, {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new[c] = c + "_"
            while new[c].lower() in taken:
                new[c] += "_"
            taken.add(new[c].lower())
    return df.withColumnsRenamed(new)


def n_words(text: Column) -> Column:
    """Words of a text, 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with the column ``name``: 0, 1, 2, ... in each group of ``keys``, by ``order``.

    No group meets in one task: rows are range-partitioned by keys and order and sorted, and each partition's count
    for each key it holds, at most one row more than partitions and keys together, gives the offsets. Rows that
    tie in everything are numbered in any order.
    """
    pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    by = [F.col(c).asc_nulls_last() for c in [*keys, *order, "_tie"]]  # _tie deals equal rows out
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    rows = cut(rows.withColumns({"_pid": F.spark_partition_id(), "_pos": pos}))
    runs = rows.groupBy("_pid", *keys).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")).collect()
    offsets, so_far = [], {}
    for r in sorted(runs, key=lambda r: (r["_pid"], r["_first"])):
        k = tuple(r[c] for c in keys)
        offsets.append((r["_pid"], r["_first"], r["_n"], so_far.get(k, 0)))
        so_far[k] = so_far.get(k, 0) + r["_n"]
    if not offsets:
        return rows.withColumn(name, F.lit(0).cast("long")).drop("_pid", "_pos")
    spark = df.sparkSession
    at = spark.createDataFrame(offsets, "_pid int, _first long, _n long, _offset long")
    if not keys:
        at = at.select("_pid", "_first", "_offset")
        return rows.join(F.broadcast(at), "_pid").withColumn(name, F.col("_pos") - F.col("_first") + F.col("_offset")).drop("_pid", "_pos", "_first", "_offset")
    # a partition's runs as one sorted array, so that the join stays an equality of partition numbers
    at = at.groupBy("_pid").agg(F.array_sort(F.collect_list(F.struct("_first", "_n", "_offset"))).alias("_runs"))
    run = F.element_at(F.filter("_runs", lambda r: (r["_first"] <= F.col("_pos")) & (F.col("_pos") < r["_first"] + r["_n"])), 1)
    return rows.join(F.broadcast(at), "_pid").withColumn("_run", run).withColumn(name, F.col("_pos") - F.col("_run._first") + F.col("_run._offset")).drop("_pid", "_pos", "_runs", "_run")


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        n = max(n, _CHUNK + 1)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b & _MASK, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def byte_table(separators: bytes = b" \t\n\v\f\r", lower: bool = False) -> np.ndarray:
    """What each byte is hashed as; 0 separates words."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[0] = 255
    t[list(separators)] = 0
    return t


class Words:
    """The words of many texts: ``hash`` of each, and ``at[d]:at[d + 1]`` are those of text d.

    A word's hash is a polynomial of its bytes modulo 2**64, mixed; the same word has the same hash everywhere.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray):
        joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a separator after each text
        code = table[joined]
        inside = np.zeros(len(code) + 1, np.int8)
        inside[:-1] = code != 0
        edge = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.at = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(lengths)]))
        self.hash = np.empty(len(self.start), np.uint64)
        first, n = 0, len(self.start)
        while first < n:
            low = int(self.start[first])
            last = max(first + 1, int(np.searchsorted(self.end, low + _CHUNK, "right")))
            high = int(self.end[last - 1])
            p, inverse = _powers(high - low + 1)
            sums = np.empty(high - low + 1, np.uint64)
            sums[0] = 0
            np.cumsum(code[low:high] * p[: high - low], out=sums[1:])
            s, e = self.start[first:last] - low, self.end[first:last] - low
            self.hash[first:last] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            first = last

    def text_of(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows, and the text of each. A text of 1 to k - 1 words has one: all its words."""
        n = np.diff(self.at)
        out, doc = np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(self.hash) >= k:
            h = np.zeros(len(self.hash) - k + 1, np.uint64)
            for j in range(k):
                h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : len(self.hash) - k + 1 + j]
            whole = self.text_of()
            keep = whole[: len(h)] == whole[k - 1 :]
            out, doc = mix(h[keep]), whole[: len(h)][keep]
        if (short := np.flatnonzero((n > 0) & (n < k))).size:
            more = []
            for d in short:
                x = 0
                for w in self.hash[self.at[d] : self.at[d + 1]]:
                    x = (x * 0xD6E8FEB86659FD93 + int(w)) & _MASK
                more.append(x ^ 0xA5A5A5A5A5A5A5A5)
            out, doc = np.concatenate([out, mix(np.array(more, np.uint64))]), np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            out, doc = out[order], doc[order]
        return out, doc


def slices(texts: list[bytes], most: int = _CHUNK):
    """(first, last) of runs of texts of about ``most`` bytes together, at least one text each."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column's values as UTF-8; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
