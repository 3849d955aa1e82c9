"""Alignment in order against its definition by recursion, and against all alignments."""

import itertools
import random
import re
from collections import Counter
from functools import cache

from loomspan.operators import alignment


def f1(a, b):
    a, b = (Counter(re.findall("[a-z0-9]+", x.casefold())) for x in (a, b))
    if not a or not b:
        return float(not a and not b)
    shared = (a & b).total()
    precision, recall = shared / a.total(), shared / b.total()
    return 2 * precision * recall / (precision + recall) if shared else 0.0


def by_recursion(left, right):
    @cache
    def best(i, j):
        """(sum, rank of the choice, what to do last) of the first i and j."""
        if not i or not j:
            return 0.0, 0, None
        options = [(best(i, j - 1)[0], 0, (i, j - 1, None)), (best(i - 1, j)[0], 1, (i - 1, j, None))]
        if alike := f1(left[i - 1], right[j - 1]):
            options.append((best(i - 1, j - 1)[0] + alike, 2, (i - 1, j - 1, alike)))
        return max(options, key=lambda o: o[:2])

    i, j, matches = len(left), len(right), []
    while i and j:
        i, j, alike = best(i, j)[2]
        matches += [(i, j, alike)] if alike else []
    return best(len(left), len(right))[0], matches[::-1]


def captions(r, n):
    return [" ".join(r.choices(["a", "b", "c", "The", "the", "é", "x1"], k=r.randint(0, 3))) for _ in range(n)]


def test_every_pair_equals_the_definition_ties_included():
    r = random.Random(1)
    for _ in range(600):
        left, right = captions(r, r.randint(0, 9)), captions(r, r.randint(0, 9))
        assert alignment.align(left, right) == by_recursion(left, right)


def test_the_sum_is_the_greatest_of_all_alignments():
    r = random.Random(2)
    for _ in range(60):
        left, right = captions(r, r.randint(0, 4)), captions(r, r.randint(0, 5))
        every = [sum(f1(left[i], right[j]) for i, j in zip(a, b, strict=True)) for k in range(min(len(left), len(right)) + 1) for a in itertools.combinations(range(len(left)), k) for b in itertools.combinations(range(len(right)), k)]
        assert abs(alignment.align(left, right)[0] - max(every)) < 1e-12


def test_long_lists():
    r = random.Random(3)
    left, right = captions(r, 300), captions(r, 400)
    assert alignment.align(left, right)[0] > 150


def test_odd_rows(spark):
    rows = [(1, None, ["a"]), (2, ["a", None], []), (3, ["A  b"], [None, "a b"]), (4, None, None)]
    out = alignment.caption_alignment(spark.createDataFrame(rows, "id int, predicted array<string>, target array<string>"), "predicted", "target")
    assert {r["id"]: (r["alignment"]["n_predicted"], r["alignment"]["n_target"], [tuple(m) for m in r["alignment"]["matches"]], r["alignment"]["extra"]) for r in out.collect()} == {1: (0, 1, [], 0.0), 2: (2, 0, [], 1.0), 3: (1, 2, [(0, 1, 1.0)], 0.0), 4: (0, 0, [], 0.0)}
    plans = "array<struct<caption:string,segments:array<string>>>"
    given = spark.createDataFrame([(1, [("a b", None), ("c", ["x", "X "])], [("a", ["q"]), ("c", ["x", None])], True), (2, None, None, None)], f"plan int, p {plans}, t {plans}, ok boolean").withColumnRenamed("plan", "id")
    got = {r["id"]: r["plan"] for r in alignment.plan_alignment(given, "p", "t", "ok").collect()}
    assert (got[1]["n_segments"], got[1]["n_target_segments"], got[1]["repeated_segments"], got[1]["segment_score"], got[1]["segment_coverage"]) == (2, 3, 0.5, 0.25, 0.25)
    assert (got[2]["valid"], got[2]["strict_score"], got[2]["segment_score"]) == (False, 0.0, 0.0)
