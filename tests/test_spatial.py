"""Joins of boxes against brute force."""

import random

from lattika.operators import spatial


def test_overlaps(spark):
    rnd = random.Random(3)

    def boxes(n, sizes):
        out = []
        for i in range(n):
            lows = [rnd.randrange(-200, 200) for _ in range(3)]
            out.append((i, *[x for a in lows for x in (a, a + rnd.choice(sizes))]))
        return out

    schema = "id int, x0 int, x1 int, y0 int, y1 int, z0 long, z1 long"
    a = [*boxes(60, [0, 1, 2, 3, 64, 65, 300]), (60, *[-(10**9), 10**9] * 3), (61, None, 5, 0, 5, 0, 5), (62, 5, 4, 0, 5, 0, 5)]
    b = [*boxes(80, [1, 4, 31, 32, 128]), (80, 0, 1, 0, 1, 0, 1), (80, 0, 1, 0, 1, 0, 1)]
    got = sorted(tuple(r) for r in spatial.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).select("left.id", "right.id", "x0", "x1", "y0", "y1", "z0", "z1").collect())
    want = []
    for p in a[:61]:
        for q in b:
            cut = [(max(p[i], q[i]), min(p[i + 1], q[i + 1])) for i in (1, 3, 5)]
            if all(u < v for u, v in cut):
                want.append((p[0], q[0], *[x for c in cut for x in c]))
    want.sort()
    assert (len(got), [p for p in got if p not in want][:3], [p for p in want if p not in got][:3]) == (len(want), [], [])
    assert got == want and len(got) > 80
    none = spark.createDataFrame([], schema)
    assert spatial.overlaps(none, none).count() == 0 and spatial.overlaps(spark.createDataFrame(a, schema), none).count() == 0


def test_overlaps_in_two_axes(spark):
    a = spark.createDataFrame([(0, 10, 0, 10), (20, 21, 0, 1)], "x0 long, x1 long, y0 long, y1 long")
    got = spatial.overlaps(a, a, "xy").select("x0", "x1", "y0", "y1").collect()
    assert sorted(map(tuple, got)) == [(0, 10, 0, 10), (20, 21, 0, 1)]


def test_long_boxes_of_many_shapes(spark):
    """Levels of each axis by itself, made coarser when boxes have too many shapes; the side that seems small is not broadcast."""
    rnd = random.Random(5)
    shapes = [(2**i, 2**j, 2**k) for i in range(5) for j in range(5) for k in range(5)]
    assert spatial.coarsened([{(0, 9, 3)}]) == 1 and spatial.coarsened([set(shapes), set()]) > 1
    rows = [(i, *[x for a in s for low in [rnd.randrange(-40, 40)] for x in (low, low + a)]) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, "id int, x0 long, x1 long, y0 long, y1 long, z0 long, z1 long")
    pairs = spatial.overlaps(df, df)
    want = sorted((p[0], q[0]) for p in rows for q in rows if all(max(p[i], q[i]) < min(p[i + 1], q[i + 1]) for i in (1, 3, 5)))
    assert sorted(tuple(r) for r in pairs.select("left.id", "right.id").collect()) == want
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


def _boxes(rnd, n, span, sides):
    return [(i, *[x for s in sides() for low in [rnd.randrange(*span)] for x in (low, low + s)]) for i in range(n)]


def _brute(a, b):
    return sorted((p[0], q[0]) for p in a for q in b if all(max(p[i], q[i]) < min(p[i + 1], q[i + 1]) for i in range(1, len(p), 2)))


def test_boxes_of_many_sizes_are_moved_once(spark):
    """Many boxes of small, varied sides and some large ones against a few of varied sides: rows that are shuffled stay near the number of boxes, not one for each combination of levels."""
    rnd = random.Random(7)
    schema = "id int, x0 long, x1 long, y0 long, y1 long, z0 long, z1 long"
    views = _boxes(rnd, 40, (0, 4000), lambda: (s := rnd.randrange(1, 900), 2 * s, 100))
    blocks = _boxes(rnd, 6000, (0, 4000), lambda: [rnd.randrange(1, 64) + (2000 if rnd.random() < 0.01 else 0)] * 3)
    for a, b in ((views, blocks), (blocks, views)):
        spark.sparkContext.setJobGroup(f"moved-{a is views}", "")
        got = spatial.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).select("left.id", "right.id").collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert sorted(map(tuple, got)) == _brute(a, b) and len(got) > 300
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        status, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
        stages = {s for j in status.getJobIdsForGroup(f"moved-{a is views}") for s in status.getJobInfo(j).stageIds}
        moved = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
        assert len(a) + len(b) <= moved < 3 * (len(a) + len(b))


def test_ways_of_layout(spark):
    """Each way of laying out, alone and beside the others, near the ends of the range too."""
    small, large = (0, 0), (5, 5)
    few, many = (10, (2, 2), (1.0, 1.0)), (10**6, (2, 2), (1.0, 1.0))
    whole = lambda left, right: [w for w, _ in spatial.layouts({small: left}, {small: right})[small]]
    assert (whole(few, few), whole(few, many), whole(many, few)) == ([True, True], [True, False], [False, True])
    assert set(spatial.layouts({small: few, large: few}, {large: few})) == {large}
    of = lambda sizes: {tuple(max(0, (s - 1).bit_length() - 1) for s in w): (m, w, w) for w, m in sizes.items()}
    views, blocks = of({(100, 50): 30, (300, 50): 30, (900, 50): 40}), of({(5, 5): 10**5, (60, 60): 10**5, (2000, 2000): 10**3})
    assert spatial.highest(views, blocks, [4000, 1000]) == (9, 5)
    one = {**views, **of({(2**30, 2**30): 1})}
    assert max(spatial.highest(one, blocks, [4000, 1000])) < 10  # one huge box doesn't put all others into one cell
    rods = of({(2**20, 1, 1): 10**4, (1, 2**20, 1): 10**4, (1, 1, 2**20): 10**4})
    assert spatial.highest(rods, rods, [2.0**20] * 3) == (0, 0, 0)
    rnd, schema = random.Random(11), "id int, x0 long, x1 long, y0 long, y1 long"
    for low in (-(2**63), 2**63 - 700):
        a = _boxes(rnd, 30, (low, low + 300), lambda: [rnd.choice([1, 2, 5, 40, 300]) for _ in range(2)])
        b = _boxes(rnd, 900, (low, low + 300), lambda: [rnd.choice([1, 3, 4, 60]) for _ in range(2)])
        for left, right in ((a, b), (b, a)):
            got = spatial.overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "xy").select("left.id", "right.id").collect()
            assert sorted(map(tuple, got)) == _brute(left, right) != []
