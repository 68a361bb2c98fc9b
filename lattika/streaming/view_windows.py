"""View windows as a stream: each change of a client's view sends what that client lacks, as far as its present rate goes.

State is a map from bin to bytes already sent, one value for each client, read and written once a micro-batch; bins have a time to live. A bin that the rate cuts goes on where it stopped, with the next view that
needs it. The same rules run over a table, in order, with one client's map in memory at a time, so that a stream and a table of the same requests give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bins_of_view(x: Column, y: Column, width: int, height: int, tile: int, across: int, down: int, levels: int, size: int) -> Column:
    """array<struct<bin, size>>: what a view needs, coarse levels first, then tiles near its centre, then by number.

    The finest level has ``across`` by ``down`` tiles of ``tile`` samples, each coarser one half as many of twice the width. A bin is level * 65536 + tile; coarse bins have
    the same ``size`` as fine ones.
    """

    def of_level(level: int) -> Column:
        wide = tile << (levels - 1 - level)
        n, m = -(-across * tile // wide), -(-down * tile // wide)

        def axis(at: Column, length: int, count: int) -> Column:
            return F.sequence(F.greatest(F.lit(0), F.floor(at / wide)), F.least(F.lit(count - 1), F.floor((at + length - 1) / wide)))

        def one(tx: Column, ty: Column) -> Column:
            dx, dy = 2 * tx * wide + wide - 2 * x - width, 2 * ty * wide + wide - 2 * y - height
            return F.struct(F.lit(level).alias("level"), (dx * dx + dy * dy).cast("long").alias("far"), (ty * n + tx + level * 65536).cast("long").alias("bin"), F.lit(size).cast("long").alias("size"))

        return F.flatten(F.transform(axis(y, height, m), lambda ty: F.transform(axis(x, width, n), lambda tx: one(tx, ty))))

    every = F.array_sort(F.concat(*map(of_level, range(levels))))
    return F.transform(every, lambda b: F.struct(b["bin"].alias("bin"), b["size"].alias("size")))


def deliver(bins: Iterable[tuple[int, int]], budget: int, sent: dict[int, int]) -> list[tuple[int, int, bool]]:
    """(bin, bytes, whole) of what goes out now; ``sent`` is brought up to date."""
    out = []
    for number, size in bins:
        if budget <= 0:
            break
        more = min(size - sent.get(number, 0), budget)
        if more > 0:
            sent[number] = sent.get(number, 0) + more
            budget -= more
            out.append((number, more, sent[number] == size))
    return out


def _serve(rows: pd.DataFrame, sent: dict[int, int]) -> list[tuple]:
    out = []
    for r in rows.itertuples(index=False):
        given = deliver(zip(r.bins.tolist(), r.sizes.tolist(), strict=True) if r.bins is not None else [], 0 if pd.isna(r.budget) else int(r.budget), sent)
        out += [(r.client, r.at, r.request, place, *g) for place, g in enumerate(given)]
    return out


_RESULT = "client {0}, at timestamp, request long, place int, bin long, bytes long, whole boolean"
_NAMES = ["client", "at", "request", "place", "bin", "bytes", "whole"]


class _Sender(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", "bins array<long>, bytes array<long>, at array<long>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        now = timerValues.getCurrentProcessingTimeInMs()
        sent, times = {}, {}
        for number, n, at in zip(*(self.sent.get() or ([], [], [])), strict=True):
            if self.ttl_ms is None or at + self.ttl_ms > now:
                sent[number], times[number] = n, at
        before = dict(sent)
        out = _serve(pd.concat(list(rows)).sort_values(["at", "request"], kind="stable"), sent)
        times |= {number: now for number, n in sent.items() if before.get(number) != n}
        if sent != before:  # what outlived its time goes with the next write
            self.sent.update((list(sent), list(sent.values()), [times[number] for number in sent]))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def send_views(requests: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """client, at, request, bins (array<struct<bin, size>>) and budget (bytes) -> client, at, request, place, bin, bytes and whole of all that is sent.

    ``requests`` is a stream or a table; request numbers tell a client's simultaneous requests apart. In a stream, rows of a micro-batch are taken in order, and what was sent is
    forgotten ``ttl_ms`` after it was last written. Null bins and budgets send nothing.
    """
    rows = requests.select("client", F.col("at").cast("timestamp").alias("at"), "request", F.col("bins.bin").alias("bins"), F.col("bins.size").alias("sizes"), F.col("budget").cast("long").alias("budget"))
    result = _RESULT.format(dict(rows.dtypes)["client"])
    if requests.isStreaming:
        requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # states of transformWithState need it
        return rows.groupBy("client").transformWithStateInPandas(_Sender(ttl_ms), result, "append", "processingTime" if ttl_ms else "none")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, sent = None, {}
        for frame in frames:
            out = []
            for key, own in frame.groupby("client", sort=False, dropna=False):
                key = (None if pd.isna(key) else key,)  # never None itself, as before the first client
                if key != client:
                    client, sent = key, {}
                out += _serve(own, sent)
            yield pd.DataFrame(out, columns=_NAMES)

    return rows.repartition("client").sortWithinPartitions("client", "at", "request").mapInPandas(fold, result)


def adapted_budget(rates: Column, congested: Column, seconds: float, base: int) -> Column:
    """Bytes that a client may get now: its measured rate for ``seconds``, half of that while congested, and ``base`` before the first measurement."""
    return F.floor(F.coalesce(rates, F.lit(base)) * seconds * F.when(congested, 0.5).otherwise(1.0)).cast("long")


def drain(stream: DataFrame) -> DataFrame:
    """What a stream gives for all its source has now, as a table. It is written below the checkpoint folder."""
    import uuid

    from ..operators.staging import folder

    spark, at = stream.sparkSession, f"{folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
