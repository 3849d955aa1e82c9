import random
import re

import numpy as np
import pytest

from loomspan.llm import decontaminate as dc


def length_of_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_equals_dynamic_programming():
    r = random.Random(3)
    for _ in range(200):
        a = np.array([r.randrange(6) for _ in range(r.randrange(1, 90))])
        b = np.array([r.randrange(6) for _ in range(r.randrange(0, 90))])
        assert dc.lcs(a, b) == length_of_lcs(a.tolist(), b.tolist())


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["ta", "ri", "mo", "ken", "lu", "ést"]) for _ in range(r.randint(2, 4)))
    pool = [word() for _ in range(900)]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(i, text(r.randint(16, 70))) for i in range(40)]
    docs, truth = [], set()
    for i in range(160):
        words = text(r.choice([3, 20, 150, 600])).split()
        if i % 4 == 0:
            k, passage = items[i // 4]
            body = passage.split()
            if i % 8 == 0:  # a paraphrase: some words replaced, some left out
                for j in range(3, len(body), 9):
                    body[j] = word()
                del body[5::11]
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() if i % 16 == 4 else w for w in body]
            truth.add((i, k))
        docs.append((i, " ".join(words), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (4, docs[4][1], "x")]
    schema = "doc_id long, text string, item_id string"
    return spark.createDataFrame(docs, schema), spark.createDataFrame([*items, (77, "too short"), (78, None)], "item_id long, text string"), docs, items, truth


def test_matches_equal_brute_force(tables):
    """Every passage against every stretch of every document: found are those with the passage in order."""
    docs, benchmark, rows, items, truth = tables
    found = [(r.doc_id, r.item_id) for r in dc.matches(docs, benchmark).collect()]
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    brute = set()
    for d, text, _ in rows:
        w = norm(text)
        for k, passage in items:
            p = norm(passage)
            if any(length_of_lcs(p, w[j : j + len(p) + 4]) >= 0.75 * len(p) for j in range(0, max(1, len(w) - len(p) // 2), 4)):
                brute.add((d, k))
    assert truth <= brute
    assert len(brute - set(found)) <= 0.1 * len(brute)
    assert set(found) <= brute
    assert found.count((4, 1)) == 2


def test_removal_keeps_clean_rows_and_columns(tables):
    docs, benchmark, rows, _, truth = tables
    kept = dc.remove(docs, benchmark)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert {d for d, _, _ in rows} - {d for d, _ in truth} <= left
    assert len(left & {d for d, _ in truth}) <= 4


def test_empty_tables(spark, tables):
    docs, benchmark = tables[0], tables[1]
    assert dc.matches(docs.limit(0), benchmark).collect() == []
    assert dc.matches(docs, benchmark.limit(0)).collect() == []
    assert dc.remove(docs, benchmark.limit(0)).count() == docs.count()


def invented(r, n, pool=4000):
    return " ".join(f"w{int(pool * r.random() ** 2)}" for _ in range(n))


def test_every_exact_copy_of_many_items_is_found(spark):
    r = random.Random(5)
    items = [(i, invented(r, 38)) for i in range(2000)]
    docs = [(i, f"{invented(r, 40)} {items[i][1]} {invented(r, 70)}") for i in range(0, 2000, 4)]
    docs += [(10_000, f"{items[3][1]} {items[7][1]}"), (10_001, invented(r, 300))]
    want = {(i, i) for i, _ in docs if i < 2000} | {(10_000, 3), (10_000, 7)}
    got = [(m.doc_id, m.item_id) for m in dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got) == sorted(want)


def test_passages_keep_their_length_in_every_block(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(i, invented(r, 200)) for i in range(50)], "doc_id long, text string")
    blocks, every = dc.indexes(docs, spark.createDataFrame([(i, invented(r, 38)) for i in range(600)], "item_id long, text string"))
    assert blocks > 1
    for index in every:
        for words in index.words:
            bucket, weight = dc._vector(words, index.idf)
            assert np.linalg.norm(weight @ index.basis[index.place[bucket]]) > 0.999


def test_an_item_in_two_fifths_of_the_documents_is_found(spark):
    r = random.Random(7)
    items = [(1, invented(r, 24)), (2, invented(r, 40))]
    docs = [(i, f"{invented(r, 60)} {items[0][1] if i % 5 < 2 else ''} {invented(r, 60)}") for i in range(400)]
    got = sorted((m.doc_id, m.item_id) for m in dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(i, 1) for i in range(400) if i % 5 < 2]


def test_an_item_of_several_blocks_has_one_row(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 1)
    r = random.Random(8)
    body = invented(r, 300)
    docs = spark.createDataFrame([(1, body), (1, body), (2, "x")], "doc_id long, text string")
    got = [(m.doc_id, m.item_id) for m in dc.matches(docs, spark.createDataFrame([(9, body)], "item_id long, text string")).collect()]
    assert got == [(1, 9), (1, 9)]
