"""Boxes of two or three dimensions joined where they overlap, by cells of grids of many levels.

Each axis has its own level: the one whose cells are at least half as wide as the box is along it, however long and thin the box is. Levels below a floor are raised to it, so most boxes share one level; the floor is as
high as it may be without comparing many more pairs. Two boxes meet, axis by axis, at the coarser of their levels. Each box is laid out at those that it has with the other side's boxes, and cells join by equality, so no side
is joined whole. At each level the way that makes fewer rows is taken: both sides are in all cells that they touch (three of an axis at most), or one is in the cell of its low corner alone and the other in all cells
from which such a box may reach it (five of an axis at most). There are ``COMBINATIONS`` of levels at most, whatever sizes are.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Combinations of levels of a side's boxes at most; beyond, levels are made coarser.
COMBINATIONS = 64
#: Floors to try, highest first: the share of all pairs of boxes that lie no higher along an axis.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)
#: Times as many pairs as without a floor may be compared, or as many as there are boxes.
COMPARED = 4


def side_level(side: Column) -> Column:
    """The least level whose cells (2 ** level wide) are at least half as wide as ``side``."""
    return F.when(side <= 2, 0).otherwise(F.length(F.bin(F.call_function("shiftright", side - 1, F.lit(1)))))


def coarsened(combinations: list[set[tuple[int, ...]]], most: int = COMBINATIONS) -> int:
    """The least step whose multiples, when levels are raised to them, leave ``most`` combinations a side."""
    return next(s for s in range(1, 65) if all(len({tuple(-(-k // s) for k in c) for c in side}) <= most for side in combinations))


def floors(left: dict, right: dict, share: float) -> tuple[int, ...]:
    """The least level of each axis that ``share`` of all pairs of boxes don't exceed; the sides are as in ``layouts()``."""
    below = lambda side, i, k: sum(c[0] for levels, c in side.items() if levels[i] <= k) / sum(c[0] for c in side.values())
    axes = range(len(next(iter(left))))
    return tuple(next(k for k in sorted({c[i] for c in (*left, *right)}) if below(left, i, k) * below(right, i, k) >= share or k == max(c[i] for c in (*left, *right))) for i in axes)


def compared(left: dict, right: dict, floor: tuple[int, ...], spans: list[float]) -> float:
    """About how many pairs share a cell, if low corners lie evenly over ``spans``."""
    wide = lambda a, b: ((x + y + 2 ** max(k)) / s for x, y, s, *k in zip(left[a][2], right[b][2], spans, a, b, floor))
    return sum(left[a][0] * right[b][0] * prod(min(1.0, w) for w in wide(a, b)) for a in left for b in right)


def highest(left: dict, right: dict, spans: list[float]) -> tuple[int, ...]:
    """The floor of each axis: the highest with which not many more pairs are compared than without one."""
    none = (0,) * len(spans)
    most = max(COMPARED * compared(left, right, none, spans), sum(c[0] for c in (*left.values(), *right.values())))
    return next((f for f in (floors(left, right, s) for s in SHARES) if compared(left, right, f, spans) <= most), none)


def layouts(left: dict, right: dict) -> dict[tuple[int, ...], tuple[tuple[bool, tuple[int, ...]], ...]]:
    """For each level at which boxes meet, each side's way: whether its boxes are in all cells that they touch (else in that of their low corner) and how far ahead of their low corner, by axis.

    ``left`` and ``right`` have, by level, the number of boxes, their longest sides and their average ones.
    """
    meet: dict[tuple[int, ...], tuple[set, set]] = {}
    for a in left:
        for b in right:
            both = meet.setdefault(tuple(map(max, a, b)), (set(), set()))
            both[0].add(a)
            both[1].add(b)
    out = {}
    for level, both in meet.items():
        met = [[side[c] for c in own] for side, own in zip((left, right), both)]
        longest = [[max(m) for m in zip(*(c[1] for c in side))] for side in met]
        rows = lambda side, ahead: sum(n * prod((m + r) / 2**k + 1 for m, r, k in zip(mean, ahead, level)) for n, _, mean in side)
        number, none = [sum(c[0] for c in side) for side in met], (0,) * len(level)
        ahead = [tuple(m - 1 for m in longest[1 - i]) for i in (0, 1)]
        ways = (
            (rows(met[0], none) + rows(met[1], none), ((True, none), (True, none))),
            (rows(met[0], ahead[0]) + number[1], ((True, ahead[0]), (False, none))),
            (number[0] + rows(met[1], ahead[1]), ((False, none), (True, ahead[1]))),
        )
        out[level] = min(ways)[1]
    return out


def _merged(classes: dict, to) -> dict:
    """Classes of boxes that have the same levels after ``to`` as one."""
    out: dict = {}
    for c, (n, most, mean) in classes.items():
        n0, most0, mean0 = out.get(to(c), (0, most, mean))
        out[to(c)] = (n0 + n, tuple(map(max, most0, most)), tuple((x * n0 + y * n) / (n0 + n) for x, y in zip(mean0, mean)))
    return out


def _number(levels: tuple[int, ...]) -> int:
    return sum(k << 6 * (len(levels) - 1 - i) for i, k in enumerate(levels))


def _packed(levels: list[Column]) -> Column:
    """Levels in 6 bits each, the last axis lowest."""
    out = levels[0]
    for k in levels[1:]:
        out = out * 64 + k
    return out.cast("int")


def _level(packed: Column, axes: str, i: int) -> Column:
    return F.call_function("shiftright", packed, F.lit(6 * (len(axes) - 1 - i))).bitwiseAND(63)


def _cells(df: DataFrame, axes: str, grids: dict[tuple[int, ...], dict[tuple[int, ...], tuple[bool, tuple[int, ...]]]]) -> DataFrame:
    """df with a row for each cell of its box at each level that ``grids`` has for its own, laid out the level's way."""
    way = lambda k, whole, ahead: f"named_struct('level', {_number(k)}, 'whole', {whole}, {', '.join(f"'{a}', {r}L" for a, r in zip(axes, ahead))})"
    kind = f"array<struct<level: int, whole: boolean, {', '.join(f'{a}: bigint' for a in axes)}>>"
    cases = "".join(f" WHEN {_number(own)} THEN array({', '.join(way(k, *w) for k, w in at.items())})" for own, at in grids.items())
    rows = df.withColumn("_grid", F.explode(F.expr(f"CASE _own{cases} END" if grids else f"CAST(NULL AS {kind})"))).withColumn("_level", F.col("_grid.level"))
    for i, a in enumerate(axes):
        k, low, ahead = _level(F.col("_level"), axes, i), F.col(f"{a}0"), F.col(f"_grid.{a}")
        first = F.greatest(low, F.lit(-(2**63)) + ahead) - ahead
        last = F.when(F.col("_grid.whole"), F.col(f"{a}1") - 1).otherwise(low)
        rows = rows.withColumn(f"_{a}", F.explode(F.sequence(F.call_function("shiftright", first, k), F.call_function("shiftright", last, k))))
    return rows.drop("_grid")


def _full(df: DataFrame, axes: str) -> DataFrame:
    """Boxes that hold something; nulls and empty boxes overlap nothing. Coordinates become long."""
    keep = F.lit(True)
    for a in axes:
        df = df.withColumns({f"{a}{k}": F.col(f"{a}{k}").cast("bigint") for k in "01"})
        keep = keep & F.coalesce(F.col(f"{a}0") < F.col(f"{a}1"), F.lit(False))
    return df.filter(keep)


def overlaps(left: DataFrame, right: DataFrame, axes: str = "xyz") -> DataFrame:
    """left and right (structs) of each pair of half-open boxes x0, x1, y0, y1, ... that overlap, once a pair, and the box of the overlap.

    Coordinates are integers, negative ones too, with sides below 2 ** 62. Columns may have equal names on both sides. The combinations of levels reach the driver; both sides
    are read twice. There may be as many results as pairs of boxes, so time grows with these.
    """
    full, found, spans = {}, {}, []
    n = len(axes)
    for side, df in (("left", left), ("right", right)):
        boxes = _full(df.select(F.struct(*df.columns).alias(side), *[f"{a}{k}" for a in axes for k in "01"]), axes)
        low, wide = [F.col(f"{a}0") for a in axes], [F.col(f"{a}1") - F.col(f"{a}0") for a in axes]
        full[side] = boxes.withColumns({f"_own_{a}": side_level(w) for a, w in zip(axes, wide)})
        sizes = [tuple(r) for r in full[side].groupBy(*[f"_own_{a}" for a in axes]).agg(F.count("*"), *map(F.max, wide), *map(F.avg, wide), *map(F.min, low), *map(F.max, low)).collect()]
        found[side] = {r[:n]: (r[n], r[n + 1 : 2 * n + 1], r[2 * n + 1 : 3 * n + 1]) for r in sizes}
        spans += [(r[n], [y - x + 1 for x, y in zip(r[3 * n + 1 :], r[4 * n + 1 :])]) for r in sizes]
    step = coarsened([set(side) for side in found.values()])
    raised = lambda c, floor: tuple(max(f, min(63, -(-k // step) * step)) for k, f in zip(c, floor))
    merged = {side: _merged(classes, lambda c: raised(c, (0,) * n)) for side, classes in found.items()}
    # where low corners lie, on average over boxes: a few that are far off or huge don't count
    floor = highest(*merged.values(), [sum(m * s[i] for m, s in spans) / sum(m for m, _ in spans) for i in range(n)]) if all(found.values()) else (0,) * n
    merged = {side: _merged(classes, lambda c: raised(c, floor)) for side, classes in found.items()}
    ways = layouts(merged["left"], merged["right"])
    laid = {}
    for j, (side, other) in enumerate((("left", "right"), ("right", "left"))):
        own = _packed([F.greatest(F.lit(f), F.least(F.lit(63), F.ceil(F.col(f"_own_{a}") / step) * step).cast("int")) for a, f in zip(axes, floor)])
        grids = {c: {k: ways[k][j] for k in sorted({tuple(map(max, c, o)) for o in merged[other]})} for c in merged[side]} if ways else {}
        cells = _cells(full[side].withColumn("_own", own).drop(*[f"_own_{a}" for a in axes]), axes, grids)
        laid[side] = cells.withColumnsRenamed({f"{a}{k}": f"_{side}_{a}{k}" for a in axes for k in "01"} | {"_own": f"_{side}_own"})
    # results outgrow the rows that are joined: partitions of few bytes must not be put together
    keys, parts = ["_level", *[f"_{a}" for a in axes]], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = {side: cells.repartition(parts, *keys) for side, cells in laid.items()}
    # sizes are estimated from the files, before boxes are laid out: a side that seems small must not be broadcast
    pairs = laid["left"].hint("merge").join(laid["right"], keys)
    low = {a: F.greatest(f"_left_{a}0", f"_right_{a}0") for a in axes}
    high = {a: F.least(f"_left_{a}1", f"_right_{a}1") for a in axes}
    keep = F.lit(True)
    for a in axes:
        keep = keep & (F.col(f"_left_{a}0") < F.col(f"_right_{a}1")) & (F.col(f"_right_{a}0") < F.col(f"_left_{a}1"))
    # a pair counts at the coarser of its levels, in the cell that holds the low corner of its overlap, or in the only one of the side that has one
    own = [[_level(F.col(f"_{side}_own"), axes, i) for side in found] for i in range(len(axes))]
    keep = keep & (F.col("_level") == _packed([F.greatest(*k) for k in own]))
    once = F.col("_level").isin([_number(k) for k, both in ways.items() if not all(whole for whole, _ in both)])
    for i, a in enumerate(axes):
        keep = keep & (once | (F.col(f"_{a}") == F.call_function("shiftright", low[a], _level(F.col("_level"), axes, i))))
    return pairs.filter(keep).select("left", "right", *[c[a].alias(f"{a}{k}") for a in axes for k, c in ((0, low), (1, high))])
