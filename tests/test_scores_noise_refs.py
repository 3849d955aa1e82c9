"""Scores, picks, paired shares, seeds and small readings against plain Python."""

import math
import random
from fractions import Fraction
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loomspan.functions import refs
from loomspan.operators import noise, scores
from loomspan.plans.targets import _WINDOW


def test_seeds_are_whole_64_bit_numbers(spark):
    rows = [(f"s{i}", 1 + i * i % 9973) for i in range(300)]
    df = spark.createDataFrame(rows, "t string, n int")
    for shift in (0, 7, 11, 19, 31):
        got = {r["t"]: r["m"] for r in df.select("t", ((noise.Seed(F.col("t")) >> shift) % F.col("n")).alias("m")).collect()}
        assert got == {t: (int(sha256(t.encode()).hexdigest()[:16], 16) >> shift) % n for t, n in rows}


def test_noise_changes_something_or_says_that_it_can_t(spark):
    schema = f"sample int, name string, long array<struct<action:string,segment:string>>, short {noise.SHORT}, plan array<struct<caption:string,segments:array<string>>>"
    rows = [(1, "a", None, None, None), (2, "a", [("x", None)], None, [("p", None)]), (3, "a", [("x", None), ("y", "z")], (5, ("c", 6), None), [("p", None), ("q", ["r"])]), (4, "a", [], (5, None, ("c", 6)), [])]
    got = {r["sample"]: r["noise"] for r in noise.noisy(spark.createDataFrame(rows, schema), "sample", "name", "long", "short", "plan").collect()}
    assert got[1]["kind"] is None and not got[1]["changed"] and got[2]["kind"] is None and got[2]["plan_kind"] == "initial_plan_duplicate_single"
    assert got[3]["changed"] and got[4]["kind"] == "progress_0_100" and got[4]["short"]["segment"]["progress"] != 6 and got[4]["plan_kind"] is None


def test_augmented_memories(spark):
    df = spark.range(2000).select("id", F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("m"))
    out = df.select(noise.augmented(F.col("m"), F.col("id"), F.lit(0.4)).alias("a")).select("a.*").collect()
    n = {k: sum(r["operation"] == k for r in out) for k in ("gt", "drop", "replace", "duplicate", "empty")}
    assert sum(n.values()) == 2000 and 1100 < n["gt"] < 1300 and min(n.values()) > 140
    assert {len(r["items"]) for r in out if r["operation"] == "drop"} == {2} and {len(r["items"]) for r in out if r["operation"] == "duplicate"} == {4}
    assert all(len(set(r["items"])) == 2 for r in out if r["operation"] == "replace")
    one = df.select(noise.augmented(F.array(F.lit("a")), F.col("id"), F.lit(1.0)).alias("a")).select("a.*").collect()
    assert {r["operation"] for r in one} == {"drop", "replace_skipped", "duplicate", "empty"}
    assert df.select(noise.augmented(F.array().cast("array<string>"), F.col("id"), F.lit(1.0)).alias("a")).select("a.operation").distinct().collect()[0][0] == "gt"


def test_targets_that_can_t_be_read(spark):
    rows = [(1, None, _WINDOW, "L3L1L0"), (2, _WINDOW, None, "L3L1L0"), (3, _WINDOW, "{", "L3L1L0"), (4, _WINDOW, "{}", "L3L1L0"), (5, _WINDOW, _WINDOW, "L9"), (6, _WINDOW, _WINDOW, "L3L1L0")]
    got = {r["id"]: (r["scored"]["score"], r["scored"]["error"]) for r in scores.target_scores(spark.createDataFrame(rows, "id int, t string, g string, p string"), "t", "g", "p").collect()}
    assert got == {1: (0.0, "target_names"), 2: (0.0, "target"), 3: (0.0, "target"), 4: (0.0, "target"), 5: (0.0, "profile"), 6: (1.0, None)}


@pytest.mark.parametrize(("n", "wanted"), [(0, 5), (3, 5), (5, 5), (7, 5), (1000, 97), (6, 2)])
def test_evenly_spaced_rows(spark, n, wanted):
    got = sorted(r["id"] for r in scores.evenly_spaced(spark.range(n), ["id"], wanted).collect())
    assert got == (list(range(n)) if n <= wanted else sorted({i * (n - 1) // (wanted - 1) for i in range(wanted)}))


def plain_pairs(leaves, total, whole):
    share = {n: (s if whole else 1) for n, _, s in leaves}
    alone = [(s, n) for n, p, s in leaves if p is None]
    rest = total - sum(share.values())
    if rest % 2:
        share[max(alone)[1]] += 1
    pairs = {}
    for n, p, s in leaves:
        pairs.setdefault(("p", p) if p is not None else ("s", n), []).append((n, s))
    units = [(max(str(n) for n, _ in own), own[0][1], [n for n, _ in own]) for own in pairs.values()]
    two, weight = rest // 2, sum(w for _, w, _ in units)
    given = {name: two * w // weight for name, w, _ in units}
    order = sorted(units, key=lambda u: (two * u[1] % weight, u[0]), reverse=True)
    for name, _, _ in order[: two - sum(given.values())]:
        given[name] += 1
    for name, _, own in units:
        for n in own:
            share[n] += given[name] * (1 if len(own) == 2 else 2)
    return share


@pytest.mark.parametrize(("total", "whole"), [(400, True), (401, True), (57, False), (20, False)])
def test_paired_shares(spark, total, whole):
    r = random.Random(total)
    leaves = [(k, k % 5 if k < 10 else None, 7 + (k % 5 if k < 10 else r.randint(1, 9))) for k in range(14)]
    rows = [(n, p, n < 5, s) for n, p, s in leaves]
    got = {x["name"]: x["share"] for x in scores.paired_allocation(spark.createDataFrame(rows, "name long, pair long, side boolean, size long"), "name", "pair", "side", "size", total, whole).collect()}
    assert got == plain_pairs(leaves, total, whole) and sum(got.values()) == total
    assert all(got[k] == got[k + 5] for k in range(5))


def test_shares_that_can_t_be(spark):
    df = spark.createDataFrame([(1, 1, True, 5), (2, 1, False, 5)], "name long, pair long, side boolean, size long")
    args = ("name", "pair", "side", "size")
    with pytest.raises(ValueError, match="less"):
        scores.paired_allocation(df, *args, 3, True)
    with pytest.raises(ValueError, match="odd"):
        scores.paired_allocation(df, *args, 11, True)
    with pytest.raises(ValueError, match="two sides"):
        scores.paired_allocation(df.where("name = 1"), *args, 7, True)


def test_sizes_and_fractions(spark):
    r = random.Random(1)
    rows = [(r.randint(1, 5000), r.randint(1, 5000)) for _ in range(500)]
    df = spark.createDataFrame(rows, "h int, w int")
    for h, w, got in df.select("h", "w", refs.resized(F.col("h"), F.col("w"))).collect():
        if h < 32 or w < 32:
            assert got is None
            continue
        assert got["height"] % 32 == got["width"] % 32 == 0 and got["height"] <= h and got["width"] <= w and max(got["height"], got["width"]) <= 640 and got["height"] * got["width"] <= 589_824
    texts = [f"{r.randint(0, 10**9 - 1)}/{r.randint(0, 10**9 - 1)}" for _ in range(50)] + ["30", "29.97", "30000/1001", "0.5", "1/0", "x", "", "1e3", None, "-1", "123456789.987654321"]
    for t, got in spark.createDataFrame([(t,) for t in texts], "t string").select("t", refs.fraction(F.col("t"))).collect():
        try:
            want = Fraction(t) if t and "e" not in t else None
        except (ValueError, ZeroDivisionError):
            want = None
        want = want if want and want > 0 else None
        assert (None if got is None else (got["numerator"], got["denominator"])) == (None if want is None else (want.numerator, want.denominator)), t
    assert math.gcd(30000, 1001) == 1


def test_captions_by_their_task(spark):
    rows = [(1, "f", "pick it", "fold the boxes", "folding box"), (2, "f", "fold", "fold", "fold"), (3, "f", None, "fold", "fold"), (4, None, "x", "", "y")]
    df = spark.createDataFrame(rows, "id int, f string, i string, d string, t string")
    assert {r[0]: r[1] for r in df.select("id", refs.detailed_caption(*map(F.col, "fidt"))).collect()} == {1: "fold the boxes", 2: "f", 3: "f", 4: None}
