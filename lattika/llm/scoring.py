"""Language-model scoring of whole documents: corpus counts, a smoothed unigram base, and a gated recurrent model.

Texts are lower-cased in A-Z; tokens are words and one end a text. The counts of all training tokens are exact sums over the corpus, by 64-bit hashes
of words. The commonest types, a bounded number, are broadcast; what remains of each document's tokens is joined to the counts of the rest.
The recurrent model's vocabulary is the commonest words of the head, the end, and one stand-in for all other words, which share its
probability by their smoothed counts. Its biases are the counts of the whole corpus. It is started on a bounded sample of segments, and then trained on all training
documents, in rounds over disjoint shares of them. In a round, workers, whose documents follow from hashes and not from the layout of the table, train from the same start,
and a tree of partial sums averages their models by tokens. Scores are thus the same under any partitioning, up to the rounding of sums.

Null text is empty: it has the end alone. An empty table gives an empty result; without training documents all counts are 0. Repeated rows
get equal scores. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, byte_table, cut, free, slices, small_batches
from .gru import Gru
from .language import held_out
from .sharding import crc32_sql

#: Types that are broadcast at most, and their least count; words of the recurrent model (their numbers take 2 bytes); its classes; documents of the first sample, which are also its segments at most.
HEAD, LEAST, VOCABULARY, CLASSES, FIRST_DOCS = 1 << 21, 3, 4096, 64, 512
#: Averaging rounds over disjoint shares that together are all documents; tokens for each worker of a round, about; workers of a round at most (with more tokens each then).
ROUNDS, CELL, WORKERS = 4, 4_000_000, 4096
#: Tokens of a segment.
SEGMENT = 2000
#: Tokens that a task scores, or trains on, together, about.
TOGETHER = 4_000_000
_TABLE = byte_table(lower=True)
FOLDS, FOLD = 7, 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> h, c: counts of words in a partition, in pieces of bounded size."""
    held_h, held_c, n = [], [], 0

    def merged():
        h, at = np.unique(np.concatenate(held_h), return_inverse=True)
        return h, np.bincount(at, np.concatenate(held_c)).astype(np.int64)

    def out(h, c):
        for a in range(0, len(h), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(h[a : a + (1 << 17)].view(np.int64)), pa.array(c[a : a + (1 << 17)])], names=["h", "c"])

    for batch in batches:
        texts = as_bytes(batch.column(0))
        for a, b in slices(texts):
            h, c = np.unique(Words(texts[a:b], _TABLE).hash, return_counts=True)
            held_h.append(h)
            held_c.append(c)
            n += len(h)
        if n > 4_000_000:
            h, c = merged()
            held_h, held_c, n = [h], [c], len(h)
            if n > 3_000_000:
                yield from out(h, c)
                held_h, held_c, n = [], [], 0
    if held_h:
        yield from out(*merged())


class Head:
    """The broadcast part: counts of common types, their places in the recurrent vocabulary, and corpus totals."""

    def __init__(self, h: np.ndarray, c: np.ndarray, least: int, tokens: int, types: int, ends: int):
        order = np.argsort(h)
        self.h, self.c, self.least = h[order], c[order], least
        self.ends, self.tokens, self.types = ends, tokens + ends, types + (ends > 0)
        top = np.lexsort((self.h, -self.c))[: VOCABULARY - 2]
        inside = int(self.c[top].sum())
        self.rest_tokens, self.rest_types = tokens - inside, types - len(top)
        counts = np.concatenate([self.c[top], [ends, self.rest_tokens]])
        by = np.argsort(-counts, kind="stable")
        self.counts = counts[by]
        number = np.empty(len(by), np.int32)
        number[by] = np.arange(len(by))
        self.end, self.other = int(number[-2]), int(number[-1])
        self.word = np.full(len(self.h), self.other, np.int32)
        self.word[top] = number[: len(top)]
        self.places: np.ndarray | None = None

    def _places(self) -> tuple[np.ndarray, np.uint64]:
        """Where the types of each value of the highest bits begin, made where it is used."""
        bits = max(1, (2 * len(self.h)).bit_length())
        shift = np.uint64(64 - bits)
        if self.places is None:
            self.places = np.append(np.searchsorted(self.h, np.arange(1 << bits, dtype=np.uint64) << shift), len(self.h)).astype(np.int32)
        return self.places, shift

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """count (-1: not in the head) and word of each hash"""
        count, word = np.full(len(h), -1, np.int64), np.full(len(h), self.other, np.int32)
        if len(self.h):
            # types by their highest bits: few share a place, so a hash is compared with one or two
            places, shift = self._places()
            place = (h >> shift).astype(np.int64)
            at, end, rest = places[place], places[place + 1], None
            while True:
                rest = np.flatnonzero(at < end) if rest is None else rest[at[rest] < end[rest]]
                if not len(rest):
                    break
                hit = self.h[at[rest]] == h[rest]
                found = rest[hit]
                count[found], word[found] = self.c[at[found]], self.word[at[found]]
                rest = rest[~hit]
                at[rest] += 1
        return count, word


def count_corpus(train: DataFrame) -> tuple[DataFrame, Head]:
    """Counts (h, c) of all words of ``train`` (text), and the head."""
    counts = train.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = cut(counts)
    # types by count, in powers of two with 16 steps each, so that the table stays small
    step = F.floor(F.log2("c") * 16)
    # rarer types than LEAST are joined at every size of corpus
    by = sorted(counts.filter(F.col("c") >= LEAST).groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r["s"])
    least, n = 1 << 62, 0
    for r in by:
        if n + r["n"] > HEAD:
            break
        least, n = r["least"], n + r["n"]
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    got = counts.filter(F.col("c") >= least).toArrow()
    head = Head(got["h"].to_numpy().view(np.uint64), got["c"].to_numpy(), least, total[0] or 0, total[1], train.count())
    return counts, head


def encode(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Of each row of ``docs`` (doc_id, held_out, text), what the rest needs in place of the text.

    mark (a hash of document and text), n_tokens; of words in the head their number and logs (base); of words outside the recurrent vocabulary their number
    and logs; the hashes of words outside the head (tail); and the words' numbers in the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for batch in batches:
            texts = as_bytes(batch.column(3))
            n_tokens, n_head, n_other, base, others, tail, words = ([] for _ in range(7))
            for a, b in slices(texts):
                w = Words(texts[a:b], _TABLE)
                c, word = head.look_up(w.hash)
                whole, hit = w.text_of(), c >= 0
                logs = np.where(hit, np.log10(np.maximum(c, 0) + 1.0), 0.0)
                rest = word == head.other
                n_tokens.append(np.diff(w.at) + 1)
                n_head.append(np.bincount(whole[hit], minlength=b - a) + (head.ends > 0))
                n_other.append(np.bincount(whole[rest], minlength=b - a))
                base.append(np.bincount(whole, logs, minlength=b - a) + np.log10(head.ends + 1.0))
                others.append(np.bincount(whole, np.where(rest, logs, 0.0), minlength=b - a))
                for x, y in zip(w.at[:-1], w.at[1:], strict=True):
                    tail.append(w.hash[x:y][~hit[x:y]].tobytes())
                    words.append(np.append(word[x:y], head.end).astype("<u2").tobytes())
            cols = [np.concatenate(x) if x else np.empty(0) for x in (n_tokens, n_head, n_other, base, others)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x, t) for x, t in zip(cols, types, strict=True)], pa.array(tail, pa.binary()), pa.array(words, pa.binary())], names=["doc_id", "held_out", "mark", "n_tokens", "n_head", "n_other", "base", "other", "tail", "words"])

    kind = "doc_id long, held_out boolean, mark long, n_tokens long, n_head long, n_other long, base double, other double, tail binary, words binary"
    rows = docs.select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("mark"), "text").mapInArrow(run, kind)
    return cut(rows.withColumn("_row", F.monotonically_increasing_id()))


def fit(train: DataFrame, head: Head, first_docs: int = FIRST_DOCS, rounds: int = ROUNDS, cell: int = CELL) -> Gru:
    """The recurrent model, trained as the module says. ``train``: rows of ``encode``."""
    model = Gru(head.counts, CLASSES, head.end)
    # the first documents by hash, whole, in segments; the segments with the least hashes, from anywhere in a text, come to the driver
    first = train.select("mark", "words").orderBy("mark").limit(first_docs)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [w[a : a + 2 * SEGMENT] for a in range(0, len(w), 2 * SEGMENT)]
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["m", "k", "w"])

    rows = first.mapInArrow(segments, "m long, k long, w binary").orderBy(F.xxhash64("m", "k"), "m", "k").limit(first_docs).collect()
    model.train([_numbers(r["w"]) for r in rows], epochs=2, n_lanes=64, batch=2048)
    workers = max(1, min(WORKERS, -(-head.tokens // (rounds * cell))))
    for k in range(rounds):
        _average(model, train.filter(F.pmod("mark", F.lit(rounds)) == k), head, workers)
    return model


def _numbers(words: bytes) -> np.ndarray:
    return np.frombuffer(words, "<u2").astype(np.int32)


def _average(model: Gru, train: DataFrame, head: Head, workers: int) -> None:
    """Trains ``model`` on all of ``train`` (mark, words): every worker from the same start, then averaged by tokens."""
    start = train.sparkSession.sparkContext.broadcast((model.vector(), head.counts, head.end))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, counts, end = start.value
        own, seen, worker = Gru(counts, CLASSES, end), 0, None
        own.load(vector)
        held, n = [], 0

        def learn() -> int:
            batch = min(8192, max(256, n // 256))
            return own.train(held, rate=0.003, n_lanes=max(8, batch // 64), batch=batch)

        for batch in batches:
            for worker, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(_numbers(w))
                n += len(held[-1])
                if n > TOGETHER:
                    seen += learn()
                    held, n = [], 0
        seen += learn() if held else 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([worker], pa.int64()), pa.array([(own.vector().astype(np.float64) * seen).tobytes()], pa.binary()), pa.array([float(seen)])], names=["worker", "v", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, group = 0, 0.0, 0
        for batch in batches:
            for w, v, k in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                total, n, group = total + np.frombuffer(v, np.float64), n + k, w // 16
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([n])], names=["worker", "v", "n"])

    rows = train.select(F.pmod(F.xxhash64("mark"), F.lit(workers)).alias("worker"), "words", "mark").repartitionById(workers, F.col("worker").cast("int")).sortWithinPartitions("mark")
    kind = "worker long, v binary, n double"
    sums, left = cut(rows.mapInArrow(local, kind)), workers
    while left > 1:
        left = -(-left // 16)
        group = sums.repartitionById(left, F.floor(F.col("worker") / 16).cast("int")).sortWithinPartitions("worker")
        more = cut(group.mapInArrow(add, kind))
        free(sums)
        sums = more
    if got := sums.collect():
        model.load(np.frombuffer(got[0]["v"], np.float64) / got[0]["n"])
    free(sums)
    start.unpersist()


def _tails(encoded: DataFrame, counts: DataFrame, head: Head) -> DataFrame:
    """_row, _known and _logs: of the words outside the head, how many are known, and their logs."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(np.frombuffer(x, np.int64), return_counts=True) for x in batch.column(1).to_pylist()]  # a word once for each document
            if own:
                row = np.repeat(batch.column(0).to_numpy(), [len(h) for h, _ in own])
                h, n = (np.concatenate(x) for x in zip(*own, strict=True))
                for a in range(0, len(h), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 17)]) for x in (row, h, n)], names=["_row", "h", "n"])

    # a rare type has fewer than ``least`` training tokens, and an unseen one no count: only held-out documents can have many
    tail = encoded.filter(F.length("tail") > 0).select("_row", "tail").mapInArrow(rest, "_row long, h long, n long")
    found = tail.join(counts.filter(F.col("c") < head.least), "h")
    return found.groupBy("_row").agg(F.sum("n").alias("_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("_logs"))


def _prepare(docs: DataFrame) -> tuple[DataFrame, DataFrame, Head]:
    """The encoded table, the counts of all training words, and the head."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts, head = count_corpus(docs.filter("not held_out"))
    return encode(docs, docs.sparkSession.sparkContext.broadcast(head)), counts, head


def _base(head: Head) -> list:
    """The columns of a result that need no model, from rows of ``encode`` joined to ``_tails``."""
    base = F.col("base") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(head.tokens + head.types + 1)))
    known = F.col("n_head") + F.coalesce("_known", F.lit(0))
    return ["doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(head.tokens).cast("long").alias("train_tokens"), base.alias("base_score")]


def base_scores(docs: DataFrame) -> DataFrame:
    """The columns of ``score`` but the model's."""
    encoded, counts, head = _prepare(docs)
    return encoded.join(_tails(encoded, counts, head), "_row", "left").select(*_base(head))


def base_sql() -> str:
    """DuckDB SQL for base_scores over documents, rounded to 6 places."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(({crc32_sql("doc_id::VARCHAR")}) % {FOLDS} = {FOLD}, false) AS held_out, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^ 	-
]+') AS w FROM documents),
x AS (SELECT k, held_out, unnest(list_append(list_transform(w, lambda y: 'w' || y), 'end')) AS t FROM d),
c AS (SELECT t, count(*) AS c FROM x WHERE NOT held_out GROUP BY t),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
s AS (SELECT k, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base FROM x LEFT JOIN c USING (t), n GROUP BY k)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 6) AS base_score FROM d JOIN s USING (k), n
"""


def score(docs: DataFrame, first_docs: int = FIRST_DOCS, rounds: int = ROUNDS, cell: int = CELL) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    encoded, counts, head = _prepare(docs)
    trained = spark.sparkContext.broadcast(fit(encoded.filter("not held_out"), head, first_docs, rounds, cell))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            got = trained.value.score([_numbers(w) for w in rows.column("words").to_pylist()])
            return rows.drop_columns(["words"]).append_column("gru", pa.array(got)).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += sum(batch.column("n_tokens").to_pylist())
            if n > TOGETHER:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    kind = "_row long, doc_id long, held_out boolean, n_tokens long, n_head long, n_other long, base double, other double"
    own = [x.split()[0] for x in kind.split(", ")]
    scored = encoded.select(*own, "words").mapInArrow(run, f"{kind}, gru double")
    rows = scored.join(_tails(encoded, counts, head), "_row", "left")
    full = F.col("gru") + F.col("other") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_other") * F.lit(float(np.log10(head.rest_tokens + head.rest_types + 1)))
    return rows.select(*_base(head), full.alias("score"))
