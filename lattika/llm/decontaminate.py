"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters (case folded), digits and non-ASCII bytes; all other bytes part them. A document's 5-token seeds that
occur in a benchmark item make the pair a candidate. Its tiles are then found greedily: the longest matches of unmarked
tokens first, by running Karp-Rabin with a window that shrinks, no token in two tiles. A document is contaminated by an
item if tiles cover at least ``coverage`` of the item's tokens; as tiles may lie anywhere, passages cut up and reordered count.

The benchmark is the stated query set: it is broadcast in blocks of a bounded number of tokens, and all documents meet each block where they lie, without a
shuffle. An item of fewer tokens than a seed must occur whole. Items and documents without tokens, and nulls, match nothing. Repeated document
rows give one result. A null item_id names the item as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, byte_table, slices, small_batches

#: Tokens of a seed and so of the shortest tile; share of an item that tiles must cover; tokens in a broadcast block.
SEED, COVERAGE, BLOCK_TOKENS = 5, 0.6, 2_000_000

_TABLE = byte_table(bytes(b for b in range(1, 128) if not chr(b).isalnum()), lower=True)


def _window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of this size."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, out, width, done = np.uint64(0xD6E8FEB86659FD93), np.zeros(n, np.uint64), 1, 0
    power = tokens.copy()  # power[i]: hash of the width tokens from i on, for width 1, 2, 4, ...
    factor = base
    with np.errstate(over="ignore"):
        while width <= size:
            if size & width:
                out = out * factor + power[done : done + n]
                done += width
            if width * 2 <= size:
                power = power[:-width] * factor + power[width:]
                factor = factor * factor
            width *= 2
    return out


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item start, doc start, length) of greedy tiles of at least ``least`` tokens, longest first; ties by item, then doc position."""
    marked_i, marked_d, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []

    def free(marked: np.ndarray, size: int) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(marked)])
        return np.flatnonzero(taken[size:] == taken[:-size]) if len(marked) >= size else np.empty(0, np.int64)

    size = len(item)
    while size >= least:
        at_i, at_d = free(marked_i, size), free(marked_d, size)
        longest = []
        if len(at_i) and len(at_d):
            hi, hd = _window_hashes(item, size)[at_i], _window_hashes(doc, size)[at_d]
            by: dict[int, list[int]] = {}
            for i, h in zip(at_i.tolist(), hi.tolist(), strict=True):
                by.setdefault(h, []).append(i)
            for k in np.flatnonzero(np.isin(hd, hi)).tolist():
                longest += [(i, int(at_d[k])) for i in by.get(int(hd[k]), ())]
        for i, d in sorted(longest):
            if not marked_i[i : i + size].any() and not marked_d[d : d + size].any() and (item[i : i + size] == doc[d : d + size]).all():
                marked_i[i : i + size] = marked_d[d : d + size] = True
                out.append((i, d, size))
        # the longest run of seeds left bounds the next window
        at_i, at_d = free(marked_i, least), free(marked_d, least)
        if not len(at_i) or not len(at_d):
            break
        seeds = at_i[np.isin(_window_hashes(item, least)[at_i], _window_hashes(doc, least)[at_d])]
        if not len(seeds):
            break
        runs = np.split(seeds, np.flatnonzero(np.diff(seeds) != 1) + 1)
        size = min(size - 1, max(len(r) for r in runs) + least - 1)
    return out


class Block:
    """Benchmark items, ready for lookups: seeds sorted, with the item of each."""

    def __init__(self, ids: list, texts: list[bytes]):
        w = Words(texts, _TABLE)
        self.ids, self.items = ids, [w.hash[a:b] for a, b in zip(w.at[:-1], w.at[1:], strict=True)]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {min(SEED, len(x)) for x in self.items} - {0}:
            got = [(h, k) for k, x in enumerate(self.items) if min(SEED, len(x)) == size for h in (_window_hashes(x, size),)]
            h, k = np.concatenate([x for x, _ in got]), np.concatenate([np.full(len(x), k) for x, k in got])
            order = np.argsort(h, kind="stable")
            self.by_size[size] = h[order], k[order]

    def matches(self, texts: list[bytes], coverage: float):
        """(text, item, tokens of the item, tokens covered, tiles) for each contaminated pair."""
        for a, b in slices(texts):
            w = Words(texts[a:b], _TABLE)
            whole = w.text_of()
            pairs = []
            for size, (h, k) in self.by_size.items():
                own = _window_hashes(w.hash, size)
                lo = np.searchsorted(h, own)
                hit = np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == own)
                hit = hit[whole[hit] == whole[hit + size - 1]] if len(hit) else hit
                lo, hi = lo[hit], np.searchsorted(h, own[hit], "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pairs.append(np.unique(np.stack([np.repeat(whole[hit], n), k[at]], axis=1), axis=0))
            for d, k in np.concatenate(pairs).tolist() if pairs else ():
                item, doc = self.items[k], w.hash[w.at[d] : w.at[d + 1]]
                least = min(SEED, len(item))
                # what the seeds cover bounds what tiles can
                seeds = np.flatnonzero(np.isin(_window_hashes(item, least), _window_hashes(doc, least)))
                upto = np.zeros(len(item) + 1, np.int64)
                np.add.at(upto, seeds, 1)
                np.add.at(upto, seeds + least, -1)
                if (np.cumsum(upto)[:-1] > 0).sum() < coverage * len(item):
                    continue
                found = tiles(item, doc, least)
                covered = sum(t[2] for t in found)
                if covered >= coverage * len(item):
                    yield a + d, k, len(item), covered, len(found)


def blocks(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> Iterator[Broadcast]:
    """The benchmark (item_id, text) in broadcast blocks. A block has about ``block_tokens`` tokens, so it and what the driver holds are bounded."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // (4 * block_tokens))
    for b in range(n):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        if own:
            yield benchmark.sparkSession.sparkContext.broadcast(Block([r["item_id"] for r in own], [r["text"].encode() for r in own]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_tokens (of the item), n_covered, coverage and n_tiles of each contaminated document and item."""
    small_batches(docs.sparkSession)
    out = None
    for block in blocks(benchmark):

        def match(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], block.value.ids[k], n, c, t) for d, k, n, c, t in block.value.matches(as_bytes(batch.column(1)), coverage)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "item_id", "n_tokens", "n_covered", "n_tiles"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(match, "doc_id long, item_id long, n_tokens long, n_covered long, n_tiles long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_tokens long, n_covered long, coverage double, n_tiles long")
    best = F.max(F.struct("n_covered", "n_tokens", "n_tiles")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_tokens", "b.n_covered", (F.col("b.n_covered") / F.col("b.n_tokens")).alias("coverage"), "b.n_tiles")


def leaked(text: Column, block: Broadcast, coverage: float = COVERAGE) -> Column:
    """Whether a text is contaminated by an item of the block."""

    @F.pandas_udf("boolean")
    def test(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            out = np.zeros(len(x), bool)
            for d, *_ in block.value.matches([t.encode() if t else b"" for t in x], coverage):
                out[d] = True
            yield pd.Series(out)

    return test(text)


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, all columns."""
    small_batches(docs.sparkSession)
    for block in blocks(benchmark):
        docs = docs.filter(~leaked(F.col("text"), block, coverage))
    return docs
