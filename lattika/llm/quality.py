"""Quality rules: a learned decision list over text statistics.

The statistics of every whole text come from one Arrow function; the list is an ordered chain of Spark conditional
expressions over them. Each of its rules is a conjunction of thresholds that rejects. Sequential covering learns them: a rule grows on
two thirds of the labelled rows by information gain, drops its last conditions while that helps on the other third, and is kept
if it is precise there; the rows that it covers go, and the next rule grows.

Null and empty texts have no words: all statistics are 0 and the base rule rejects them. Rates of a text without words are null, and a
null fails every threshold. Labels with a null are left out; a document with several labels has the lowest. Without
labels, or without any of one class, the list is empty. Repeated rows get equal verdicts. Columns of ``docs``
other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

#: Labelled rows that the list is learned from, at most: those with the lowest hashes.
FIT_ROWS = 8000
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
STATS_TYPE = "struct<" + ",".join(f"{x}:bigint" for x in STATS) + ">"

_HAS_WORD = re.compile(rb"[^ \t-\r]")
_NOT_UPPER, _TRAILING = bytes(set(range(256)) - set(range(65, 91))), bytes(range(128, 192))


def text_stats(text: bytes) -> tuple[int, ...]:
    """The values of STATS for one text in UTF-8."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - (0 if text.isascii() else len(text) - len(text.translate(None, _TRAILING)))
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if _HAS_WORD.search(x)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen: dict = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            upto = 0  # words before it are counted
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(text.translate(None, _NOT_UPPER)), len(lines)


def stats_column(text: Column) -> Column:
    """The statistics of a text as a struct; JVM expressions take it from there."""

    @F.pandas_udf(STATS_TYPE)
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in texts:
            yield pd.DataFrame([text_stats(t.encode()) if t else (0,) * len(STATS) for t in x], columns=list(STATS))

    return stats(text)


def features(s: str) -> dict[str, Column]:
    """Features of a statistics struct; null where a text has no words. None depends on a text's length as such."""
    words = F.nullif(F.col(f"{s}.n_words"), F.lit(0))
    return {
        "word_length": F.col(f"{s}.word_chars") / words,
        "symbols_per_word": F.col(f"{s}.n_symbols") / words,
        "repeat_share": F.col(f"{s}.n_repeat_words") / words,
        "dup_line_share": F.col(f"{s}.n_dup_lines") / F.nullif(F.col(f"{s}.n_lines"), F.lit(0)),
        "upper_share": F.col(f"{s}.n_upper") / F.nullif(F.col(f"{s}.word_chars"), F.lit(0)),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v >= self.threshold if self.above else v < self.threshold

    def column(self, by: dict[str, Column]) -> Column:
        c = by[self.feature]
        return F.coalesce(c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold), F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray, cuts: dict[str, np.ndarray]) -> tuple[float, Condition | None]:
    p, n = y.sum(), (~y).sum()
    base, best = np.log2(p / (p + n)), (0.0, None)
    for f, at in cuts.items():
        # rows below each threshold, by class
        place = np.searchsorted(at, x[f], "right")
        below_p, below_n = (np.cumsum(np.bincount(place[k & ~np.isnan(x[f])], minlength=len(at) + 1))[:-1] for k in (y, ~y))
        has_p, has_n = (y & ~np.isnan(x[f])).sum(), (~y & ~np.isnan(x[f])).sum()
        for above in (True, False):
            cp, cn = (has_p - below_p, has_n - below_n) if above else (below_p, below_n)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(cp > 0, cp * (np.log2(cp / (cp + cn)) - base), 0.0)
            if len(gain) and gain[i := int(np.argmax(gain))] > best[0] + 1e-9:
                best = (float(gain[i]), Condition(f, above, float(at[i])))
    return best


def learn(rows: pd.DataFrame, bad: np.ndarray, prune: np.ndarray, precision: float = 0.95, least: int = 5, most_rules: int = 16, most_conditions: int = 4, n_cuts: int = 256) -> list[Rule]:
    """Ordered rejecting rules from features (columns of rows, NaN for null), the class to reject and the rows held for pruning."""
    x = {f: rows[f].to_numpy(float) for f in rows}
    cuts = {}
    for f, v in x.items():
        v = np.unique(v[~np.isnan(v)])
        mid = (v[1:] + v[:-1]) / 2
        cuts[f] = mid if len(mid) <= n_cuts else np.unique(np.quantile(mid, np.linspace(0, 1, n_cuts)))
    rules, left = [], np.ones(len(bad), bool)
    while len(rules) < most_rules:
        grow, check = left & ~prune, left & prune
        if (bad & grow).sum() < least:
            break
        rule: Rule = ()
        while len(rule) < most_conditions:
            on = grow & _covers(rule, x, len(bad))
            if not (~bad & on).any():
                break
            _, c = _best_condition({f: v[on] for f, v in x.items()}, bad[on], cuts)
            if c is None:
                break
            rule = (*rule, c)

        def score(r: Rule, on: np.ndarray = check) -> float:
            hit = on & _covers(r, x, len(bad))
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / (p + n + 1)

        while len(rule) > 1 and score(rule[:-1]) >= score(rule):
            rule = rule[:-1]
        hit = left & _covers(rule, x, len(bad)) if rule else np.zeros(len(bad), bool)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        held = hit & prune
        if p < least or p / (p + n) < precision or (held & ~bad).sum() > (1 - precision) * max(held.sum(), 1) + 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learns from at most ``fit_rows`` rows of ``docs`` that ``labels`` (doc_id, quality) covers; 0 is the class to reject."""
    small_batches(docs.sparkSession)
    own = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
    rows = rows.select("doc_id", "quality", F.xxhash64("doc_id", "text").alias("_h"), stats_column(F.col("text")).alias("_s"))
    got = rows.orderBy("_h", "doc_id").limit(fit_rows).select("quality", "_h", *[c.alias(k) for k, c in features("_s").items()]).toPandas()
    got = got.sort_values(list(got), kind="stable")
    return learn(got[list(features("_s"))].astype(float), got["quality"].to_numpy() == 0, (got["_h"].to_numpy() % 3) == 0)


def verdict(rules: list[Rule], s: str) -> Column:
    """The first rule that fires, from 1, or 0: an ordered chain of conditional expressions."""
    by, out = features(s), None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column(by)
        for c in rule[1:]:
            test = test & c.column(by)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed(s: str) -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    n, r = F.col(f"{s}.n_words"), F.col(f"{s}.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def judge(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, further statistics and rule (0: none fired) of each row of ``docs``."""
    small_batches(docs.sparkSession)
    rules = fit(docs, labels) if rules is None else rules
    rows = docs.select("doc_id", stats_column(F.col("text")).alias("_s")).select("doc_id", "_s", verdict(rules, "_s").alias("rule"), base_failed("_s").alias("base_failed"))
    first, more = STATS[:5], STATS[5:]
    return rows.select("doc_id", *[F.col(f"_s.{x}").alias(x) for x in first], "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), *[F.col(f"_s.{x}").alias(x) for x in more], "rule")


def keep_good(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns."""
    small_batches(docs.sparkSession)
    rules = fit(docs, labels) if rules is None else rules
    rows = docs.select(F.struct(*docs.columns).alias("_row"), stats_column(F.col("text")).alias("_s"))
    return rows.filter(~base_failed("_s") & (verdict(rules, "_s") == 0)).select("_row.*")


def base_sql() -> str:
    """DuckDB SQL for doc_id, the base statistics and base_failed over documents."""
    return r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM d WHERE len(w) > 2),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1) GROUP BY k),
s AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""
