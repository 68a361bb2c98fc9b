"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the 1- to 4-byte windows of its words, lower-cased in A-Z and with a mark at either end of a word, each hashed to a
bucket with an embedding. The mean embedding goes through a linear layer and a softmax. Stochastic gradient descent in numpy
learns both from a bounded sample of labelled rows; a held part of the sample sets the softmax temperature, so that scores are
probabilities, and the score below which a prediction is rejected. As everything is linear up to the softmax, a prediction
sums one row of a small table for each subword of the whole text.

A text that is null or has no letter is ``und`` with score 0 and rejected. Ties go to the lesser language. Without labelled rows every text is ``und``.
Repeated rows get equal results. Columns other than doc_id, text and lang aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, byte_table, slices, small_batches

#: Learned from about this many rows of each language, or an even share of the second if that is less, and of all at most.
ROWS_PER_LANGUAGE, FIT_ROWS = 700, 8000
BITS, DIM, SIZES = 15, 16, (1, 2, 3, 4)
UNKNOWN = "und"
_TABLE = byte_table(lower=True)


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and the text of each, in any order within a text."""
    joined = np.frombuffer(b" " + b" ".join([*texts, b""]), np.uint8)
    code = _TABLE[joined]
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])  # of byte i of the texts with separators
    inside = code != 0
    h = np.zeros(len(code), np.uint32)
    buckets, owner = [], []
    alive = np.ones(len(code), bool)
    for n in range(1, max(SIZES) + 1):
        # windows [i, i + n): no separator but at the ends
        k = len(code) - n + 1
        if k < 1:
            break
        h = h[:k] * np.uint32(0x01000193) + code[n - 1 :].astype(np.uint32) + np.uint32(1)
        if n >= 3:
            alive = alive[:k] & inside[n - 2 : n - 2 + k]
        else:
            alive = alive[:k]
        if n in SIZES:
            good = inside[:k] if n == 1 else inside[:k] | inside[1:] if n == 2 else alive
            at = np.flatnonzero(good)
            x = h[at] + np.uint32(n * 0x3C6EF372)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            buckets.append((x >> np.uint32(32 - BITS)).astype(np.int32))
            owner.append(text[np.minimum(at, len(text) - 1)] if n == 1 else text[np.clip(at, 0, len(text) - 1)])
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owner)


def has_letter(text: bytes) -> bool:
    return text.upper() != text.lower() or (not text.isascii() and any(c.isalpha() for c in text.decode()))


@dataclass
class Model:
    langs: list[str]
    #: Class scores of each bucket (buckets x languages), and of no subwords.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return lang, score
        for a, b in slices(texts):
            bucket, owner = subwords(texts[a:b])
            n = np.bincount(owner, minlength=b - a)
            z = np.stack([np.bincount(owner, self.table[bucket, j], minlength=b - a) for j in range(len(self.langs))], axis=1)
            z = (z / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for i in range(b - a):
                if n[i] and has_letter(texts[a + i]):
                    lang[a + i], score[a + i] = self.langs[best[i]], float(p[i, best[i]])
        return lang, score


def train(counts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 0) -> Model:
    """Learns from (buckets, counts) of each text; a fifth of the texts is held for calibration."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    E, W, b = (rng.standard_normal((1 << BITS, DIM)) * 0.1).astype(np.float32), np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)

    def rows(ids: np.ndarray) -> np.ndarray:
        x = np.zeros((len(ids), 1 << BITS), np.float32)
        for r, i in enumerate(ids):
            k, c = counts[i]
            x[r, k] = c / c.sum()
        return x

    weight = (len(y) / len(langs) / np.maximum(np.bincount(y, minlength=len(langs)), 1)).astype(np.float32)  # languages count alike
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (E, W, b)]
    steps, step = max(1, epochs * -(-len(own) // batch)), 0
    for _ in range(epochs):
        rng.shuffle(own)
        for a in range(0, len(own), batch):
            ids, step = own[a : a + batch], step + 1
            x = rows(ids)
            m = x @ E
            z = m @ W + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(ids)), y[ids]] -= 1
            g = p * weight[y[ids], None] / len(ids)
            grads = (x.T @ (g @ W.T), m.T @ g, g.sum(axis=0))
            lr = np.float32(rate * (1 - (step - 1) / steps))
            for v, d, (first, second) in zip((E, W, b), grads, moments, strict=True):  # steps scaled by running moments
                first += 0.1 * (d - first)
                second += 0.01 * (d * d - second)
                v -= lr * (first / np.float32(1 - 0.9**step)) / (np.sqrt(second / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    model = Model(langs, E @ W, b, 1.0, 0.0)
    if len(held):
        z = np.concatenate([rows(held[a : a + 256]) @ model.table + b for a in range(0, len(held), 256)])

        def loss(t: float) -> tuple[float, np.ndarray]:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
            logs, e = np.log(np.maximum(p, 1e-30)), 1 / (len(held) + 2)  # a held part without errors doesn't prove that there are none
            return -((1 - e) * logs[np.arange(len(held)), y[held]] + e * logs.mean(axis=1)).mean(), p

        model.temperature = float(min(np.geomspace(0.05, 20, 80), key=lambda t: loss(t)[0]))
        p = loss(model.temperature)[1]
        right, top = p.argmax(axis=1) == y[held], p.max(axis=1)
        # the least score from which on 99 % of the held predictions are right
        by = np.argsort(-top, kind="stable")
        share = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
        good = np.flatnonzero(share >= 0.99)
        model.least = float(top[by][good[-1]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, usable: Column, per_language: int = ROWS_PER_LANGUAGE, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from rows of ``docs`` that are usable and have a language: about ``per_language`` of each, or ``fit_rows`` / languages if that is less; ``fit_rows`` in all at most."""
    small_batches(docs.sparkSession)
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not n:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 0.0)
    langs = sorted(n)
    per_language = max(1, min(per_language, fit_rows // len(langs)))
    rate = F.lit(0.0)
    for k in langs:
        rate = F.when(F.col("lang") == k, min(1.0, per_language / n[k])).otherwise(rate)
    sample = rows.filter(F.shiftrightunsigned("_h", 11) * F.lit(2.0**-53) < rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, buckets, counts = as_bytes(batch.column(1)), [], []
            for t in texts:
                k, c = np.unique(subwords([t])[0], return_counts=True)
                buckets.append(k.astype(np.uint16).tobytes())
                counts.append(c.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "h", "buckets", "counts"])

    got = sample.select("lang", "text", "_h").mapInArrow(count, "lang string, h long, buckets binary, counts binary").filter(F.length("buckets") > 0)
    # by another hash than the one drawn by, so that the limit cuts all languages alike
    got = sorted(got.orderBy(F.xxhash64("h", F.lit("limit")), "h").limit(fit_rows).collect(), key=lambda r: (r["h"], r["lang"]))
    at = {k: i for i, k in enumerate(langs)}
    return train([(np.frombuffer(r["buckets"], np.uint16).astype(np.int32), np.frombuffer(r["counts"], np.uint32).astype(np.float32)) for r in got], np.array([at[r["lang"]] for r in got]), langs)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted (the score is not below the calibrated threshold) of each row of ``docs``."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, ~held_out(F.col("doc_id")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS and the number of languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.predict(as_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([s >= shared.value.least and k != UNKNOWN for s, k in zip(score, lang, strict=True)], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
