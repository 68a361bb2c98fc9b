"""Quality layers over the coding passes of images: every layer takes the steepest passes that no earlier one has, up to its own budget.

A layer ends with the pass that brings it to 95 % of its budget, and the next one begins behind it: running sums that restart where the data say. Images of up to ``SHORT`` passes
move once, whole, and a task cuts many of them at a time. Of a larger one, the passes are summed once, by slots of their slope, and each cut is then the first sum beyond the last cut's by the layer's budget: one aggregation a layer, no image in an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .slots import by_length, join_same, running_sum, whole_groups
from .staging import staged

#: Passes of an image that is cut whole, at most.
SHORT = 1 << 16


def quality_rate(quality: Column) -> Column:
    """Bits a sample for a quality from 0 to 1."""
    return F.when(quality >= 1, 24.0).otherwise(0.1 + 7.9 * quality * quality)  # fixed values


def layer_budgets(bits: Column, layers: int, samples: Column) -> Column:
    """Bytes of each layer: even shares of the bits a sample, each with those of the layers before it."""
    return F.array(*[F.floor(bits * float(k) / float(layers) * samples / 8).cast("long") for k in range(1, layers + 1)])


def estimated_passes(blocks: DataFrame, passes: Column, size: Column, samples: Column, empty_planes: Column, decay: str = "norm") -> DataFrame:
    """A row for each pass of each block: pass, pass_bytes, total_bytes, distortion and slope.

    Distortion starts at samples times 4 to the empty planes and falls with the share of passes, by its square (``norm``) or evenly (``even``). Bytes are spread evenly, 1 a pass at least.
    """
    rows = blocks.withColumns({"_n": passes.cast("long"), "_d": samples * F.pow(F.lit(4.0), empty_planes)}).filter("_n > 0")
    rows = rows.withColumn("pass_bytes", F.greatest(F.lit(1), F.floor(size / F.col("_n"))).cast("long"))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))

    def left(k: Column) -> Column:
        share = k / F.col("_n").cast("double")
        return F.when(k == 0, F.col("_d")).otherwise(F.col("_d") * (1.0 - (share * share if decay == "norm" else share)))

    rows = rows.withColumns({"total_bytes": F.col("pass_bytes") * (F.col("pass") + 1), "distortion": left(F.col("pass") + 1)})
    return rows.withColumn("slope", (left(F.col("pass")) - F.col("distortion")) / (F.col("pass_bytes") * 8.0)).drop("_n", "_d")


def assign_layers(passes: DataFrame, keys: list[str], budgets: list[Column], order: list[str], size: str, slope: str, short: int = SHORT) -> DataFrame:
    """passes with ``layer``, from 0, null beyond the last one. ``budgets`` are bytes, columns of the image; ``order`` tells equal slopes apart.

    A layer takes one pass at least while there are any. Null slopes come last. Sizes are not negative. Images of up to ``short`` passes are cut whole.
    """
    few, many = by_length(passes, keys, short)
    return _short_layers(few, keys, budgets, order, size, slope).unionByName(_long_layers(many, keys, budgets, order, size, slope))


def _short_layers(passes: DataFrame, keys: list[str], budgets: list[Column], order: list[str], size: str, slope: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(slope).desc_nulls_last(), *map(F.col, order))
    goals = {f"_goal{k}": F.coalesce(F.floor(b * 0.95).cast("long"), F.lit(0)) for k, b in enumerate(budgets)}
    rows = passes.withColumn("_i", F.row_number().over(w).cast("long")).sortWithinPartitions(*keys, "_i")
    rows = rows.withColumns({"_s": F.coalesce(F.col(size).cast("long"), F.lit(0)), **goals})

    names = list(goals)

    def cut(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        s, ends = rows.column("_s").to_numpy(), np.append(starts[1:], rows.num_rows)
        before = np.cumsum(s) - s
        at, past, layer = np.arange(rows.num_rows), starts, np.zeros(rows.num_rows, np.int32)
        for name in names:
            goal = rows.column(name).to_numpy()[starts]
            reached = np.searchsorted(before, before[np.minimum(past, rows.num_rows - 1)] + goal)
            past = np.minimum(np.maximum(reached, past + 1), ends)
            layer += at >= np.repeat(past, ends - starts)
        return rows.drop_columns(["_i", "_s", *names]).append_column("layer", pa.array(layer, mask=layer == len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole_groups(batches, cut)

    return rows.mapInArrow(run, StructType([*passes.schema.fields, StructField("layer", IntegerType())]))


def _long_layers(passes: DataFrame, keys: list[str], budgets: list[Column], order: list[str], size: str, slope: str) -> DataFrame:
    by = [F.col(slope).desc_nulls_last(), *map(F.col, order)]
    # an octave of slopes is a slot: it rises where the slope falls
    slot = F.when(F.col(slope).isNull(), 1_000_000).when(F.col(slope) > 0, -F.floor(F.log2(F.col(slope)))).otherwise(100_000)
    rows = running_sum(passes.withColumns({"_s": F.col(size).cast("long"), **{f"_goal{k}": F.floor(b * 0.95) for k, b in enumerate(budgets)}}), keys, slot, by, _sum=F.col("_s"), _at=F.lit(1).cast("long"))
    rows = staged(rows)
    cuts = rows.select(*keys).distinct().withColumns({"_from": F.lit(0).cast("long"), "_past": F.lit(0).cast("long")})
    narrow = rows.select(*keys, "_s", "_sum", "_at", *[f"_goal{k}" for k in range(len(budgets))])
    for k in range(len(budgets)):
        far = join_same(narrow, cuts.select(*keys, "_from", "_past"), keys, "inner")
        within = (F.col("_at") > F.col("_past")) & ((F.col("_sum") - F.col("_s") - F.col("_from") < F.col(f"_goal{k}")) | (F.col("_at") == F.col("_past") + 1))
        ends = far.groupBy(*keys).agg(F.max(F.when(within, F.col("_sum"))).alias("_to"), F.max(F.when(within, F.col("_at"))).alias(f"_end{k}"))
        cuts = join_same(cuts, ends, keys).withColumns({"_from": F.coalesce("_to", "_from"), "_past": F.coalesce(f"_end{k}", "_past"), f"_end{k}": F.coalesce(f"_end{k}", "_past")}).drop("_to")
    layer = None
    for k in range(len(budgets)):
        here = F.col("_at") <= F.col(f"_end{k}")
        layer = F.when(here, k) if layer is None else layer.when(here, k)
    out = join_same(rows, cuts.drop("_from", "_past"), keys).withColumn("layer", layer.cast("int"))
    return out.drop("_s", "_sum", "_at", *[f"_goal{k}" for k in range(len(budgets))], *[f"_end{k}" for k in range(len(budgets))])


def contributions(assigned: DataFrame, keys: list[str], block: str, number: str) -> DataFrame:
    """keys, layer, block, passes: how far each layer that touches a block takes it, and the bytes it adds."""
    return assigned.filter("layer is not null").groupBy(*keys, "layer", block).agg((F.max(number) + 1).alias("passes"))


def lossless_layer(blocks: DataFrame, keys: list[str], block: str, passes: str) -> DataFrame:
    """One layer with all passes of the blocks that have any."""
    return blocks.filter(F.col(passes) > 0).select(*keys, F.lit(0).alias("layer"), block, F.col(passes).alias("passes"))
