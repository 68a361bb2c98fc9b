"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files. ``*.ids``: the raw ids of its records, little-endian, 2 bytes each while every id is below 65,536, else 4.
``*.idx``: a JSON header line, then arrays: record keys (int64), null flags, record starts (one more than records), and
the index: bit levels of the perfect hash with ranks, fingerprints and first records in hash order.
Records are in ascending key order, null first; records with equal keys are neighbours, and the index points to the first of
them in that shard. A key's first record is found by a constant number of probes: its levels, a rank, a fingerprint and a start; how many records it has, by a binary search over
the runs of equal keys, which are found once when a shard is opened.

Null text is empty: it has the end id alone. Tokens are those of the library, as the file configures it, for the whole text: strings of special tokens
give their ids. Words that came before in the same worker are remembered, as the tokenizer treats words apart. Files are written under a temporary name and
then moved, so a task that runs again leaves the same files. The manifest has the first and last key of each shard, which sends a key to its shards.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, as_bytes, mix, small_batches, work_dir

#: Ids in a shard after which the next one begins.
SHARD_IDS = 1 << 24
#: Words that a worker remembers.
REMEMBERED = 1_000_000
_NULL_KEY = np.uint64(0x6A09E667F3BCC909)

# ---- minimal perfect hash -------------------------------------------------------------------------------------------


def _probe(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(bits)).astype(np.int64)


def build_hash(keys: np.ndarray, gamma: float = 1.5) -> list[np.ndarray]:
    """Bit levels for distinct keys (uint64): a key's place is the rank of the first set bit that it meets.

    A key sets its bit where it is alone; those that collide go on to the next level.
    """
    levels = []
    while len(keys):
        bits = max(64, -(-int(gamma * len(keys)) // 64) * 64)
        at = _probe(keys, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
        if len(levels) > 200:
            raise ValueError("keys are not distinct")
    return levels


class PerfectHash:
    """Lookups in the levels of build_hash."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, n = levels, [], 0
        for x in levels:
            self.ranks.append(n + np.cumsum(x) - x)
            n += int(x.sum())

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; -1 for keys that meet no set bit. A foreign key may get a place: its fingerprint tells."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _probe(keys[rest], k, len(bits))
            hit = bits[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
            if not len(rest):
                break
        return out


def key_hash(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    return np.where(null, _NULL_KEY, mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x243F6A8885A308D3)))


def fingerprint(hashed: np.ndarray) -> np.ndarray:
    return (mix(hashed ^ np.uint64(0x13198A2E03707344)) >> np.uint64(32)).astype(np.uint32)


# ---- files ----------------------------------------------------------------------------------------------------------


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """One shard; records must come in key order."""

    def __init__(self, folder: str, name: str, id_bytes: int):
        self.fs, self.folder = _store(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.id_bytes, self.tag = name, id_bytes, uuid.uuid4().hex
        self.out = self.fs.open_output_stream(f"{self.folder}/.{name}.{self.tag}.ids")
        self.keys, self.null, self.starts = array("q"), array("B"), array("q", [0])

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(0 if key is None else key)
        self.null.append(key is None)
        self.starts.append(self.starts[-1] + len(ids) // self.id_bytes)

    def close(self) -> tuple[str, int, int, int | None, int | None]:
        """name, records, ids, first and last key"""
        self.out.close()
        keys, null = np.array(self.keys, np.int64), np.array(self.null, bool)
        hashed = key_hash(keys, null)
        first = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]])) if len(keys) else np.empty(0, np.int64)
        levels = build_hash(hashed[first])
        place = PerfectHash(levels).place(hashed[first])
        prints, at = np.empty(len(first), np.uint32), np.empty(len(first), np.int64)
        prints[place], at[place] = fingerprint(hashed[first]), first
        parts = [keys, null, np.array(self.starts, np.int64), *[np.packbits(x) for x in levels], prints, at]
        head = {"id_bytes": self.id_bytes, "records": len(keys), "keys": len(first), "levels": [len(x) for x in levels]}
        with self.fs.open_output_stream(f"{self.folder}/.{self.name}.{self.tag}.idx") as f:
            f.write(json.dumps(head).encode() + b"\n")
            for x in parts:
                f.write(x.tobytes())
        for kind in ("ids", "idx"):
            self.fs.move(f"{self.folder}/.{self.name}.{self.tag}.{kind}", f"{self.folder}/{self.name}.{kind}")
        return self.name, len(keys), self.starts[-1], *(None if null[i] else int(keys[i]) for i in (0, -1))


class Shard:
    """A written shard: keyed access and a walk over all records."""

    def __init__(self, folder: str, name: str):
        fs, at = _store(folder)
        with fs.open_input_stream(f"{at}/{name}.idx") as f:
            raw = f.read()
        cut = raw.index(b"\n") + 1
        head, pos = json.loads(raw[:cut]), cut

        def take(dtype, n):
            nonlocal pos
            x = np.frombuffer(raw, dtype, n, pos)
            pos += x.nbytes
            return x

        n = head["records"]
        self.keys, self.null, self.starts = take(np.int64, n), take(bool, n), take(np.int64, n + 1)
        self.hash = PerfectHash([np.unpackbits(take(np.uint8, -(-b // 8)), count=b).astype(bool) for b in head["levels"]])
        self.prints, self.first = take(np.uint32, head["keys"]), take(np.int64, head["keys"])
        self.dtype = np.dtype("<u2") if head["id_bytes"] == 2 else np.dtype("<u4")
        self.file = fs.open_input_file(f"{at}/{name}.ids")
        # equal keys are neighbours: where their runs begin and how long these are, found once
        new = (self.keys[1:] != self.keys[:-1]) | (self.null[1:] != self.null[:-1])
        self.heads = np.flatnonzero(np.concatenate([[True], new])) if n else np.empty(0, np.int64)
        self.run = np.diff(np.append(self.heads, n))

    def find(self, keys: np.ndarray, null: np.ndarray) -> np.ndarray:
        """The first record of each key, or -1."""
        hashed = key_hash(keys, null)
        place = self.hash.place(hashed)
        ok = place >= 0
        ok[ok] = self.prints[place[ok]] == fingerprint(hashed[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.first[place[ok]]
        return out

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the records first to last - 1."""
        lo, hi = int(self.starts[first]), int(self.starts[last])
        self.file.seek(lo * self.dtype.itemsize)
        return np.frombuffer(self.file.read((hi - lo) * self.dtype.itemsize), self.dtype)

    def records(self, keys: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Through the index, the first record of each key (-1: none) and how many records have it."""
        first = self.find(keys, null)
        ok = first >= 0
        ok[ok] = (self.keys[first[ok]] == keys[ok]) & (self.null[first[ok]] == null[ok]) | (self.null[first[ok]] & null[ok])
        place = np.where(ok, first, 0)
        n = np.where(ok, self.run[np.searchsorted(self.heads, place, "right") - 1], 0) if len(self.heads) else np.zeros(len(keys), np.int64)
        return np.where(ok, first, -1), n

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each record with this key."""
        first, n = self.records(np.array([key or 0], np.int64), np.array([key is None]))
        return [self.ids(i, i + 1) for i in range(int(first[0]), int(first[0] + n[0]))] if n[0] else []


# ---- encoding -------------------------------------------------------------------------------------------------------

# Fixed value: the pattern by which this kind of tokenizer parts its pieces.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Encoder(dict):
    """Ids as bytes of each word (bytes without ASCII white space), by the tokenizers library.

    The tokenizer drops white space and treats what it parts as separate, so a text's ids are those of its words in turn.
    A text that holds a special token's string goes to the library as a whole.
    Unseen words go to the library in one call, and the ids that end a piece (suffix ``</w>``) tell where each word's ids end; if
    the counts don't agree, or the tokenizer isn't of this kind, each word, or the whole text, is encoded by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = spec["model"].get("end_of_word_suffix") == "</w>" and "Removed" in str(spec.get("pre_tokenizer"))
        added = spec.get("added_tokens", [])
        self.by_word &= not any(x["normalized"] for x in added)
        self.special = [x["content"].encode() for x in added]
        self.ends = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")

    def one(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.type).tobytes()

    def learn(self, words: list[bytes]) -> None:
        joined = b" ".join(words).decode()
        parts = self.tokenizer.normalizer.normalize_str(joined).split(" ") if self.tokenizer.normalizer else joined.split(" ")
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.type)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(parts) == len(words):
            upto = np.cumsum([1 if x.isalpha() else len(_PIECE.findall(x)) for x in parts])  # letters alone are one piece
            if len(last) == upto[-1] and (not len(ids) or last[-1] == len(ids)):
                cuts = np.concatenate([[0], last])[np.concatenate([[0], upto])] * self.type.itemsize
                raw = ids.tobytes()
                self.update((w, raw[a:b]) for w, a, b in zip(words, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                return
        for w in words:
            self[w] = self.one(w)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [np.array(x.ids, self.type).tobytes() for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        if len(self) > REMEMBERED:
            self.clear()
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        split = [[] if i in whole else t.split() for i, t in enumerate(texts)]  # bytes.split() parts at ASCII white space only
        new = list({w for words in split for w in words if w not in self})
        for i in range(0, len(new), 4096):
            self.learn(new[i : i + 4096])
        return [self.one(texts[i]) if i in whole else b"".join(map(self.__getitem__, words)) for i, words in enumerate(split)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- the operator ---------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes all documents' ids below ``folder`` (a URI that driver and executors reach) in ascending doc_id order.

    Returns the manifest, a row a shard: name, records, ids, first_key, last_key and start (ids of all shards before). ``tokenizer`` is the path of the file on each machine.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, writer, seq, done = encoder(tokenizer), TaskContext.get().partitionId(), None, 0, []
        end = np.array([end_id], enc.type).tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, enc.encode(as_bytes(batch.column(1))), strict=True):
                writer = writer or ShardWriter(folder, f"shard-{part:06d}-{seq:04d}", enc.type.itemsize)
                writer.add(key, ids + end)
                if writer.starts[-1] >= shard_ids:
                    done.append(writer.close())
                    writer, seq = None, seq + 1
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), [pa.string(), *[pa.int64()] * 4], strict=True)], names=["name", "records", "ids", "first_key", "last_key"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_tie")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = sorted(rows.mapInArrow(encode, "name string, records long, ids long, first_key long, last_key long").collect())  # names sort in doc_id order; a row a shard
    starts = np.concatenate([[0], np.cumsum([s["ids"] for s in shards])]).astype(int).tolist()
    return spark.createDataFrame([(*s, a) for s, a in zip(shards, starts, strict=False)], "name string, records long, ids long, first_key long, last_key long, start long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record, from the files: every key of a shard is looked up through its index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, name)
                first, n = shard.records(shard.keys[shard.heads], shard.null[shard.heads])
                if (n < 1).any() or n.sum() != len(shard.keys):
                    raise ValueError(f"{name}: the index misses keys")
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))  # the records that the index gave
                for a in range(0, len(at), ARROW_ROWS):
                    own = at[a : a + ARROW_ROWS]
                    lo, hi = int(own.min()), int(own.max()) + 1
                    ids = shard.ids(lo, hi).astype("<u4")
                    view, s, e = memoryview(ids).cast("B"), shard.starts[own], shard.starts[own + 1]
                    crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip((s - shard.starts[lo]).tolist(), (e - shard.starts[lo]).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.keys[own], pa.int64(), mask=shard.null[own]), pa.array(s + base, pa.int64()), pa.array(e - s, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = manifest.count()
    rows = manifest.select("name", "start").repartitionByRange(max(1, n), "name")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(keys: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """key and ids (array of long) of each record whose key is among ``keys`` (key: long, distinct); a key without a record gives no row.

    The shards' first and last keys (two numbers a shard) send each key to the shards that may hold it; only these are opened, once each.
    """
    shards = manifest.orderBy("name").collect()
    spark = keys.sparkSession
    low = np.array([-(2**63) if s["first_key"] is None else s["first_key"] for s in shards], np.int64)
    high = np.array([-(2**63) if s["last_key"] is None else s["last_key"] for s in shards], np.int64)
    bounds = spark.sparkContext.broadcast((low, high, [s["name"] for s in shards]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, names = bounds.value
        for batch in batches:
            at = np.array([-(2**63) if k is None else k for k in batch.column(0).to_pylist()], np.int64)
            first, last = np.searchsorted(high, at), np.searchsorted(low, at, "right")
            n = np.maximum(last - first, 0)
            which = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(at)), n))), pa.array([names[i] for i in which.tolist()], pa.string())], names=["key", "name"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, opened = None, None
        for batch in batches:
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != opened:
                    shard, opened = Shard(folder, name), name
                got = [x.astype(np.int64) for x in shard.get(key)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), pa.int64()), pa.array(got, pa.list_(pa.int64()))], names=["key", "ids"])

    sent = keys.select(F.col("key").cast("long").alias("key")).mapInArrow(send, "key long, name string")
    return sent.repartition("name").sortWithinPartitions("name").mapInArrow(read, "key long, ids array<long>")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes and reads back: the digest of every record."""
    folder = folder or work_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id), folder)
