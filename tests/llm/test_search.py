"""Ranked search against brute force and SQL; the index's order and its bounds."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomspan.llm import registry, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=50):
    """docs, items: (id, text). Rows by definition, ids None last."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    got, want = registry.QUERIES["op13_search"](spark, small), con.sql(registry.ORACLES["op13_search"])
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def topical(n, seed):
    r = random.Random(seed)
    topics = [[f"t{j}w{i}" for i in range(40)] for j in range(8)]
    return [(i, " ".join([*r.choices(topics[i % 8], k=r.randint(5, 60)), *r.choices(["the", "of", "And"], k=10)])) for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"FIRST": 1, "ROWS": 7}, {"ITEMS": 2, "TERMS": 30, "MATRIX": 1 << 12}])
def test_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(search, name, value)
    docs = topical(400, 1) + [(i, "the same copy of t1w1 t2w2") for i in range(1000, 1100)] + [(2000, "ÉTÉ été x_y 3.14 A" + "\0b" * 300), (2001, ""), (2002, None)]
    items = [(0, "t1w1 t1w2 the t1w1"), (1, "été a 3 b y"), (2, "nothing here"), (3, ""), (4, None), (5, " ".join(f"t{j}w{i}" for j in range(8) for i in range(20)))]
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    got = search.search(index, spark.createDataFrame(items, "item_id long, text string"), k=20)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 20)
    assert index.rows().count() == len(docs)
    index.drop()


def test_odd_rows(spark):
    docs = [(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (2, "a " * 400_000 + "c"), (3, "-- ..")]
    items = [(7, "a c"), (7, "a c"), (None, "b")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS n", "3 AS cluster", "4 AS score")
    index = search.build(table)
    got = search.search(index, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS row", "2 AS block"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    assert search.search(index, spark.createDataFrame([], "item_id long, text string")).collect() == []
    nothing = search.build(table.where("doc_id > 9"))
    assert search.search(nothing, spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_bisection_parts_topics():
    """Documents of two vocabularies, in mixed order, are told apart, and so are documents that it has not seen."""
    r = random.Random(3)
    rows = [np.unique([r.randrange(200) + 500 * (i % 2) for _ in range(40)]) for i in range(400)]
    weights = search.bisection(rows[:300], depth=1)
    side = np.array([weights[0, x].sum() > 0 for x in rows])
    assert len({*side[::2]}) == len({*side[1::2]}) == 1 and side[0] != side[1]


def test_shards_that_cannot_matter_are_not_visited(spark, monkeypatch):
    seen = []
    visited = search._visited
    monkeypatch.setattr(search, "_visited", lambda hits, shared, plan, k: seen.append(int(plan.value[0].sum())) or visited(hits, shared, plan, k))
    docs = topical(3000, 5)
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string"))
    items = [(0, "t1w1 t1w2 t1w3 t1w4 t1w5 the")]
    got = search.search(index, spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 3)
    assert sum(seen) < 0.6 * index.rows().select("shard").distinct().count()
