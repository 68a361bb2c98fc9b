"""Packing token ids of documents into sequences of bounded length by best-two-fit.

A document is its ids and one end id. One longer than a sequence is cut into full pieces, and what is left over is its first piece.
A bin is filled greedily: the longest unpacked piece that fits, again and again. Then its smallest piece gives way to the two unpacked
pieces that fill the widened gap best, if they fill it better, and what remains is filled greedily. A bin of one piece is left as it is.
Short pieces are held back until the others are packed, and fill gaps first.

Only lengths matter to this, and there are ``capacity`` of them, so the bins are planned on the count of each length, and a bin that
comes again is planned once with its number of copies: the plan is as if all pieces had been packed together, and its size follows from the
capacity, not from the corpus. Pieces of each length are then numbered without a group in one task, and a number's place follows from the plan.

Null text is empty: it has the end id alone. Repeated rows are documents of their own; null doc_ids are packed like others. An empty table gives
an empty result. Other columns of the documents don't matter. Very long texts are encoded whole. Rows that tie in doc_id and piece are numbered in any order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import as_bytes, cut, numbered, small_batches

#: Tokens of a sequence, and units that a worker remembers.
CAPACITY, REMEMBERED = 1024, 1_000_000

_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z")
_PART = re.compile(rb"[\x20\x09-\x0D]*[A-Za-z\x80-\xFF]+|[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z")
_WORD = re.compile(rb" ?[A-Za-z\x80-\xFF]+")
# white space beside the ASCII one, and what some libraries take for it
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
# what is neither ASCII nor surely a letter
_NO_LETTER = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]")


class Units(dict):
    """Ids as little-endian bytes of each unit. Letters with one space at most before them go to the library's merges as they are, others to the whole library."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printed]
        self.spelled = {b: b for b in printed} | {b: 256 + i for i, b in enumerate(other)}  # fixed: the characters by which byte-level tokenizers write bytes

    def library(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, unit: bytes) -> bytes:
        if _WORD.fullmatch(unit) and (unit.isascii() or not _NO_LETTER.search(unit.decode())):
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(unit.decode("latin-1").translate(self.spelled))])
        else:
            ids = self.library(unit)
        self[unit] = ids
        return ids


class ByteEncoder:
    """Ids as little-endian bytes of texts, by the tokenizers library.

    A byte-level tokenizer parts its text before white space that follows anything else, and a text of Latin letters alone after each run of
    these too, so a text's ids are those of such units in turn; units are remembered. A text with other white space or with a special token's string goes to the library as a whole, and so does every text if the tokenizer isn't of this kind.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
        self.by_unit = pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not pre.get("add_prefix_space", True) and not spec.get("normalizer") and not any(x["normalized"] for x in added)
        self.by_unit &= model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        self.special = [x["content"].encode() for x in added]
        self.units = Units(self.tokenizer)

    def encode_one(self, text: bytes) -> bytes:
        whole, pattern = not self.by_unit or any(s in text for s in self.special), _PART
        if text.isascii():
            whole = whole or text.translate(None, b"\x1c\x1d\x1e\x1f") != text
        elif _NO_LETTER.search(told := text.decode()):
            whole, pattern = whole or bool(_OTHER_SPACE.search(told)), _UNIT
        return self.units.library(text) if whole else b"".join(map(self.units.__getitem__, pattern.findall(text)))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.units) > REMEMBERED:
            self.units.clear()
        return list(map(self.encode_one, texts))


_ENCODERS: dict[str, ByteEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece (from 0), start, length and ids (little-endian unsigned 32-bit) of each piece of each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = ByteEncoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, out = [], [], [], [], []
            for i, ids in enumerate(_ENCODERS[tokenizer].encode(as_bytes(batch.column(1)))):
                ids += end
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    size = min(capacity, n % capacity or capacity) if k == 0 else capacity
                    row.append(i), piece.append(k), start.append(at), length.append(size), out.append(ids[4 * at : 4 * (at + size)])
                    at += size
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary")


def _fill(free: np.ndarray, own: dict[int, int], gap: int) -> int:
    """Puts the longest free length that fits into own, again and again; the gap that stays."""
    while gap > 0:
        fits = np.flatnonzero(free[1 : gap + 1])
        if not len(fits):
            break
        size = int(fits[-1]) + 1
        n = min(int(free[size]), gap // size)
        own[size] = own.get(size, 0) + n
        free[size] -= n
        gap -= n * size
    return gap


def _two_fit(free: np.ndarray, own: dict[int, int], gap: int) -> int:
    """The smallest of own for the two free lengths that fill its place and the gap best, if they fill it better; the gap that stays."""
    small = min(own)
    room = gap + small
    longest = np.maximum.accumulate(np.where(free > 0, np.arange(len(free)), 0))  # the longest free length up to each
    a = np.flatnonzero(free[: room + 1])
    b = np.where((free[a] > 1) & (2 * a <= room), a, longest[np.clip(np.minimum(room - a, a - 1), 0, None)])
    both = np.where(b > 0, a + b, 0)
    if not len(a) or both.max() <= small:
        return gap
    k = int(both.argmax())  # of pairs as long, the most even one: short pieces fill gaps later
    own[small] -= 1
    free[small] += 1
    for x in (int(a[k]), int(b[k])):
        own[x] = own.get(x, 0) + 1
        free[x] -= 1
    if not own[small]:
        del own[small]
    return room - int(both[k])


def _plan(counts: dict[int, int], capacity: int, held: int) -> tuple[list[tuple], int]:
    """As plan_bins; pieces shorter than ``held`` wait until the others are packed, and then fill gaps before they get bins."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, rows, bins, gaps = np.zeros(capacity + 1, np.int64), [], 0, []

    def put(own: dict[int, int], first: int, times: int, offset: int) -> None:
        for x, n in sorted(own.items(), reverse=True):
            rows.append((x, int(used[x]), n, first, offset))
            used[x] += times * n
            left[x] -= times * n
            offset += n * x

    for low, high in ((held, capacity + 1), (1, held)):
        if low == 1:  # gaps first, the narrowest first
            for gap, first, times in sorted(gaps):
                while times:
                    free, own = left.copy(), {}
                    if _fill(free, own, gap) == gap:
                        break
                    n = min(times, *(int(left[x]) // k for x, k in own.items()))
                    put(own, first, n, capacity - gap)
                    first, times = first + n, times - n
        while left[low:high].any():
            free, own = left.copy(), {}
            free[: low] = 0
            longest = int(np.flatnonzero(free)[-1])
            own[longest], free[longest] = 1, free[longest] - 1
            gap = _fill(free, own, capacity - longest)
            if gap and sum(own.values()) > 1:
                gap = _fill(free, own, _two_fit(free, own, gap))
            times = min(int(left[x]) // n for x, n in own.items())
            put(own, bins, times, 0)
            if gap:
                gaps.append((gap, bins, times))
            bins += times
    return rows, bins


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first, uses, bin, offset) by length and first, and the number of bins.

    The pieces of a length numbered from ``first`` up to the next row's go to the bins from ``bin`` on, ``uses`` to each, side by side from ``offset``.
    Short pieces are worth holding back; how short is tried in a few steps, and the plan with the fewest bins stays.
    """
    plans = [_plan(counts, capacity, max(1, capacity // k)) for k in (capacity, 32, 16, 8, 6, 4, 3)]
    rows, bins = min(plans, key=lambda x: x[1])
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others; lengths from 1 to ``capacity``) with sequence_id and offset."""
    rows = numbered(pieces, ["length"], ["doc_id", "piece"], "_n")
    plan, _ = plan_bins({r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}, capacity)  # a row a length
    keys = plan[:, 0] << 48 | plan[:, 1] if len(plan) else np.empty(0, np.int64)
    schema = StructType([f for f in rows.schema if f.name != "_n"]).add("sequence_id", LongType()).add("offset", LongType())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_n")
            length, n = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64), batch.column(at).to_numpy(zero_copy_only=False)
            row = plan[np.searchsorted(keys, length << 48 | n, "right") - 1]
            n = n - row[:, 1]
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(row[:, 3] + n // row[:, 2]), pa.array(row[:, 4] + n % row[:, 2] * length)], names=schema.names)

    return rows.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, doc_ids, offsets and ids (little-endian unsigned 32-bit, joined) of each sequence of ``packed`` pieces with ids."""
    by = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(by.alias("_p"))
    joined = F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["ids"])), ""))
    return rows.select("sequence_id", F.aggregate("_p", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"), F.col("_p.doc_id").alias("doc_ids"), F.col("_p.offset").alias("offsets"), joined.alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    Pieces are encoded once, into a table in the shared folder, where ``sequences`` can find their ids; digests alone are numbered.
    """
    pieces = cut(token_pieces(docs, tokenizer, end_id, capacity))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
