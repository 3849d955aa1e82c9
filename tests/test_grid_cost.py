"""Grid anchors: no join holds an episode's whole grid in memory; the anchors are those of plain Python."""

import random

import pytest

from loomspan.operators import hierarchy

UNITS, RANGES = "episode long, level int, id long, start long, end long", "episode long, unit long, lo long, hi long"


def test_no_grid_is_broadcast(spark):
    # episodes are few enough to be broadcast, ranges aren't; a relation takes a page of 16 MB at least, the grids have 2,000,000 rows
    held = {"spark.sql.autoBroadcastJoinThreshold": "64k", "spark.sql.maxBroadcastTableSize": "40m"}
    units = spark.createDataFrame([(e, 1, e, 0, 100000) for e in range(400)], UNITS)
    ranges = units.selectExpr("episode", "id as unit", "explode(sequence(0L, 90000L, 10000L)) as lo").selectExpr("*", "lo + 100 as hi")
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert hierarchy.grid_anchors(units, ranges, 1, 20).count() == 400 * 10 * 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _plain(units, ranges, level, stride):
    out = {}
    for e in {u[0] for u in units if u[1] == level}:
        own = [u for u in units if u[0] == e and u[1] == level]
        first, end, last = min(u[3] for u in own), max(u[4] for u in own), max(own, key=lambda u: (u[3], u[4]))[2]
        there = [r for r in ranges if r[0] == e]
        holds = lambda r, x: None not in r[2:] and r[2] <= x < r[3]
        grid = range(first, end, stride)
        out |= {(e, x): False for x in grid if any(holds(r, x) for r in there)}
        told = [r for r in there if r[1] == last]
        if told and not any(holds(r, x) for r in told for x in grid):
            out[e, min((r[2] for r in told if r[2] is not None), default=None)] = True
    return out


@pytest.mark.parametrize(("seed", "stride"), [(1, 1), (2, 7), (3, 20), (4, 1000)])
def test_anchors_against_plain_python(spark, seed, stride):
    r = random.Random(seed)
    units, ranges = [], []
    for e in range(60):
        starts = sorted(r.sample(range(-300, 300), r.randint(1, 5)))
        units += [(e, 1 if e % 9 else 0, 10 * e + k, s, s + r.choice([0, 1, 5, 40, 200])) for k, s in enumerate(starts)]
        # some reach beyond the units, overlap, come twice, are empty, turned round or have a null
        for _ in range(r.randint(0, 8)):
            lo = r.randint(-400, 500)
            ranges += [(e, r.choice([10 * e + r.randrange(5), None]), r.choice([lo, lo, lo, None]), r.choice([lo + r.choice([-3, 0, 1, 4, 30, 600]), None]))] * r.choice([1, 1, 2])
    ranges += [(99, 1, 0, 50)]
    got = hierarchy.grid_anchors(spark.createDataFrame(units, UNITS), spark.createDataFrame(ranges, RANGES), 1, stride).collect()
    want = _plain(units, ranges, 1, stride)
    assert len(got) == len(want) and {(e, x): f for e, x, f in got} == want and {False, True} == set(want.values())
