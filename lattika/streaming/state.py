"""Keyed stream operators: token buckets and running bandwidth estimates.

State is a few numbers a key. With ``silence_ms``, keys that fall silent for that processing time are forgotten; Spark then runs batches
without end to look for them, so leave it out under the trigger availableNow.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timeout(silence_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if silence_ms else GroupStateTimeout.NoTimeout


def bucket_step(tokens: int, last: int | None, now: int, size: int, rate: int) -> tuple[int, int, bool]:
    """(tokens, last refill, allowed): refill at ``rate`` a second up to twice the rate, whole tokens only, then take ``size`` if there are enough.

    Times are microseconds. Time that gives no whole token yet stays with the last refill.
    """
    if last is None:
        last = now
    elif (new := (now - last) * rate // 1_000_000) > 0:
        tokens, last = min(2 * rate, tokens + new), now
    return (tokens - size, last, True) if tokens >= size else (tokens, last, False)


def rate_limit(stream: DataFrame, rate: int, silence_ms: int | None = None) -> DataFrame:
    """client, ts, bytes -> the same with allowed: a token bucket for each client, full at first. Rows of a micro-batch are taken in time order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (2 * rate, None)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        allowed = []
        for now, size in zip(rows["ts"].astype("datetime64[us]").astype("int64").tolist(), rows["bytes"].tolist(), strict=True):
            tokens, last, ok = bucket_step(tokens, last, now, int(size), rate)
            allowed.append(ok)
        state.update((tokens, last))
        if silence_ms:
            state.setTimeoutDuration(silence_ms)
        yield rows.assign(allowed=allowed)[["client", "ts", "bytes", "allowed"]]

    return stream.groupBy("client").applyInPandasWithState(run, "client string, ts timestamp, bytes long, allowed boolean", "tokens long, last long", "append", _timeout(silence_ms))


def bandwidth_estimates(stream: DataFrame, smoothing: float = 0.7, seed: float = 5_000_000.0, keep: int = 10, silence_ms: int | None = None, from_nothing: float = 0.0) -> DataFrame:
    """client, ts, bytes, seconds, rtt -> client, ts, estimate, trend and congested after each transfer.

    State: the running estimate, the last ``keep`` throughputs and the least round trip. ``from_nothing`` is the trend where the first of these is 0.
    """
    fresh = float(1 - Decimal(str(smoothing)))  # 1 - 0.7 in doubles is not 0.3

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        estimate, last, least = state.get if state.exists else (seed, [], None)
        last, out = list(last), []
        for r in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples():
            through = r.bytes / r.seconds if r.seconds > 0 else 0.0
            estimate = fresh * through + smoothing * estimate
            last = [*last, through][-keep:]
            least = r.rtt if least is None or 0 < r.rtt < least else least
            trend = 0.0 if len(last) < 2 else max(-1.0, min(1.0, (last[-1] - last[0]) / last[0])) if last[0] > 0 else from_nothing
            out.append((r.client, r.ts, estimate, trend, bool(least and r.rtt / least > 1.5)))
        state.update((estimate, last, least))
        if silence_ms:
            state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(out, columns=["client", "ts", "estimate", "trend", "congested"])

    return stream.groupBy("client").applyInPandasWithState(run, "client string, ts timestamp, estimate double, trend double, congested boolean", "estimate double, last array<double>, least double", "append", _timeout(silence_ms))


def sent_once(stream: DataFrame, keys: list[str], at: str, forget: str = "1 hour") -> DataFrame:
    """Rows whose keys have not been sent before, within the watermark. Event time is an addition: plain arrival order has no such bound."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, forget).dropDuplicatesWithinWatermark(keys)


def stream_sessions(stream: DataFrame, keys: list[str], at: str, gap: str, forget: str = "1 hour") -> DataFrame:
    """Session windows of each key with their number of rows, closed by a silence of ``gap``."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, forget)
    return rows.groupBy(*keys, F.session_window(at, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))
