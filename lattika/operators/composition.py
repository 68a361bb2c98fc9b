"""Frames and layers as composition instructions, and steps of a player."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The loop count is a 16-bit field; greater ones mean without end, 0.
MOST_LOOPS = 65535


def instructions(frames: DataFrame, keys: list[str], order: list[str], canvas: tuple[int, int], duration: str = "duration") -> DataFrame:
    """``frames`` (width, height, duration, ...) with size 0 replaced by the canvas's, step (from 0), starts_at, and total, the sequence's duration.

    A sequence is ordered in one task: keys are animations.
    """
    own = Window.partitionBy(*keys)
    before = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = lambda c, n: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(n)).cast("bigint")
    return frames.withColumns({
        "width": size("width", canvas[0]), "height": size("height", canvas[1]), "step": (F.row_number().over(own.orderBy(*order)) - 1).cast("bigint"),
        "starts_at": F.coalesce(F.sum(duration).over(before), F.lit(0)), "total": F.sum(duration).over(own),
    })


def loop_field(loops: Column) -> Column:
    return F.when(loops <= MOST_LOOPS, loops).otherwise(0)


def next_frame(index: Column, n: Column, backward: Column, loop: Column, stepping: Column) -> tuple[Column, Column, Column]:
    """(index, backward, moved) after one step of a player among n frames; ``loop`` is none, loop or ping_pong.

    At an end, ping-pong turns round: a playing one stands on the last frame reached, a stepping one stays where it is.
    """
    inside = F.when(backward, index > 0).otherwise(index < n - 1)
    ahead, near, far = index + F.when(backward, -1).otherwise(1), F.when(backward, F.lit(0)).otherwise(n - 1), F.when(backward, n - 1).otherwise(F.lit(0))
    turned = F.when(stepping, index).otherwise(near)
    at = F.when(inside, ahead).when(loop == "loop", far).when(loop == "ping_pong", turned).otherwise(index)
    return at, F.when(~inside & (loop == "ping_pong"), ~backward).otherwise(backward), inside | (loop != "none")
