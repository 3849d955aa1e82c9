import random
import re

import pytest

from loomspan.llm import jaccard


def brute(rows, k, num, den):
    """Components by comparing all sets with all."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(s), (least.get(find(i), -1) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 10
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.6:
            w = r.choice(texts[:25]).split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w + ["x"] * r.choice([0, 0, 0, 1]))
        else:
            text = " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 8, 12, 14, 20, 25, 33, 40, 80, 150])))
        texts.append(text)
        rows.append((i, text))
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (3, rows[3][1]), (1003, rows[5][1].upper())]


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 3, 90), (2, 5, 80), (3, 1, 75)])
def test_components_equal_brute_force(spark, seed, k, num):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100).collect())
    assert got == brute(rows, k, num, 100)


def test_large_families_and_many_blocks(spark, monkeypatch):
    """Families of more than three sets go list by list, in blocks of four sets."""
    monkeypatch.setattr(jaccard, "FAMILY", 3)
    monkeypatch.setattr(jaccard, "SIDE", 4)
    rows = corpus(4)
    assert sorted(tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()) == brute(rows, 3, 90, 100)


def test_boundary_and_enumeration():
    assert jaccard.subset_sizes(9, 32, 90, 100) == [9]
    assert jaccard.subset_sizes(10, 32, 90, 100) == [9, 10]
    cheap_lists = {n: (100, 1.0) for n in range(1, 33)}
    dear_lists = {n: (100, 1e9) for n in range(1, 33)}
    assert jaccard.choose_boundary(cheap_lists, 90, 100) <= 9 < jaccard.choose_boundary(dear_lists, 90, 100)


def test_empty_table_and_one_kept(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(none).collect() == []
    rows = [(5, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (7, None, 3), (None, "a b c d e f", 4)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, cls int")).collect()
    assert sorted((r.doc_id or 0, r.cls) for r in kept) == [(0, 4), (2, 2), (7, 3)]


def test_keep_one_tells_rows_of_an_id_apart(spark):
    a, b, c = ("red " + " ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, "few"), (4, "words"), (4, "words"), (5, ""), (None, a), (None, None)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, a), (2, b), (3, c), (4, "few"), (4, "words"), (5, ""), (None, a), (None, None)]))


def test_thousands_of_near_copies_that_rarely_link(spark):
    """One text with its own few words changed each time: most pairs are below the bound, and all share their lists."""
    r = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows, w = [], base
    for i in range(1500):
        w = list(w if i % 10 == 9 else base)
        for k in r.sample(range(0, 120, 6), 1 if i % 10 == 9 else 3):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    want = {a: c for a, _, c in brute(rows, 3, 90, 100)}
    assert got == want and 1 < len(set(want.values())) < 1500


def test_overlaps_and_forest_against_plain_sets():
    import numpy as np

    r = np.random.default_rng(3)
    left = [np.unique(r.integers(0, 300, n)).astype(np.uint64) for n in r.integers(1, 60, 23)]
    right = [np.unique(r.integers(0, 300, n)).astype(np.uint64) for n in r.integers(1, 60, 17)]
    for a, b in ((left, right), (left, left)):
        apart = ~np.eye(len(a), len(b), dtype=bool) | (a is not b)  # a set and itself are no pair
        assert np.array_equal(jaccard.overlaps(a, b, 32)[apart], np.array([[len(np.intersect1d(x, y)) for y in b] for x in a])[apart])
    link = r.random((30, 20)) < 0.04
    la, lb = jaccard.forest(link)
    label = list(range(50))
    for _ in range(50):
        for i, j in np.argwhere(link):
            label[i] = label[30 + j] = min(label[i], label[30 + j])
    assert [*la, *lb] == label
    link = r.random((30, 30)) < 0.03
    link |= link.T
    same, _ = jaccard.forest(link, True)
    label = list(range(30))
    for _ in range(30):
        for i, j in np.argwhere(link):
            label[i] = label[j] = min(label[i], label[j])
    assert list(same) == label


def test_further_columns_and_a_long_text(spark):
    rows = [(1, "a b c " * 60_000 + "x y z", 1, "k"), (2, "a b c " * 60_000 + "x y z", 2, "k"), (3, "a b", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, key string")
    words = rows[0][1].split()
    shingles = len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    assert sorted(tuple(r) for r in jaccard.join(docs).collect()) == [(1, shingles, 1), (2, shingles, 1), (3, 1, 3)]
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 3]
