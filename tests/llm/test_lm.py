import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspan.llm import lm
from loomspan.llm import textbatch as tb
from loomspan.llm.common import fold_of, table


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")), "</s>"]


def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    out = []
    for i in range(300):
        size = r.choice([0, 1, 2, 5, 30, 700 if i < 3 else 10])
        body = [r.choice(words[:12]) if r.random() < 0.8 else r.choice(words) + r.choice(["", "", "x", f"y{i}"]) for _ in range(size)]
        out.append((i, " ".join(body).replace("w1", "W1") if size else r.choice(["", None])))
    return [*out, (5, out[5][1])]


class Plain:
    """The model by its definition: counts in dictionaries, probabilities by recursion."""

    def __init__(self, texts):
        train = [["</s>", *tokens(t)] for t in texts]
        self.uni = Counter(w for s in train for w in s[1:])
        self.grams = Counter(g for s in train for k in (2, 3) for g in zip(*(s[j:] for j in range(k)), strict=False))
        self.n, self.v = sum(self.uni.values()), len(self.uni)

    def count(self, context):
        return self.uni[context[0]] if len(context) == 1 else self.grams[context]

    def p(self, context, word):
        if not context:
            return (self.uni[word] + 0.1) / (self.n + 0.1 * (self.v + 1))
        k, less = lm.SMOOTHING[len(context) - 1], self.p(context[1:], word)
        return (self.grams[(*context, word)] + k * less) / (self.count(context) + k) if self.count(context) else less


def brute(rows, trained):
    """(id, tokens, known, N, base, score) by the definitions, one place after the other."""
    m = Plain([t for i, t in rows if trained(i)])
    out = []
    for i, t in rows:
        s = ["</s>", *tokens(t)]
        score = sum(math.log10(m.p(tuple(s[max(0, k - 2) : k]), s[k])) for k in range(1, len(s)))
        out.append((i, len(s) - 1, sum(m.uni[w] > 0 for w in s[1:]), m.n, sum(math.log10(m.p((), w)) for w in s[1:]), score))
    return sorted(out)


def test_the_words_of_every_context_add_up_to_one():
    """By the automaton's own arcs and failure arcs, over the vocabulary and the unknown word."""
    import numpy as np

    m = Plain([t for _, t in corpus()])
    names = [*m.uni, "?"]
    word = {w: i for i, w in enumerate(names)}
    n1 = np.array([m.uni[w] for w in names])
    two = [g for g in m.grams if len(g) == 2]
    three = [g for g in m.grams if len(g) == 3]
    pair = {g: i for i, g in enumerate(two)}
    ids = lambda gs, k: np.array([word[g[k]] for g in gs])
    built = lm.Automaton(n1, ids(two, 0), ids(two, 1), np.array([m.grams[g] for g in two]), np.array([pair[g[:2]] for g in three]), np.array([pair[g[1:]] for g in three]), ids(three, 2), np.array([m.grams[g] for g in three]), m.n + 0.1 * (m.v + 1))
    base = np.log10((n1 + 0.1) / (m.n + 0.1 * (m.v + 1)))
    every = np.arange(len(names))
    ends = {i for i, g in enumerate(two) if g[1] == "</s>"}
    for state in range(len(built.fail)):
        if state - 1 - len(names) in ends or state == len(names):
            continue  # nothing follows the end of a text, and the unknown word is no context
        _, (weight, empty) = built._step(np.full(len(names), state), every)
        weight[empty] += base[empty]
        assert abs((10**weight).sum() - 1) < 1e-9


def hold_against_brute(spark, rows, **sizes):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    got = sorted(tuple(r) for r in lm.score(docs, F.col("doc_id") % 3 != 0, **sizes).drop("learned").collect())
    for a, b in zip(got, brute(rows, lambda i: i % 3), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], abs=1e-6)


@pytest.mark.parametrize("sizes", [{}, {"block": 50, "range_bytes": 300}])
def test_scores_equal_the_ngrams_as_written(spark, sizes):
    hold_against_brute(spark, corpus(), **sizes)


def test_segments_and_blocks_leave_the_score(monkeypatch):
    """A block read in short segments gives what one left-to-right pass gives."""
    import numpy as np

    r = np.random.default_rng(1)
    words = r.integers(0, 6, 4000)
    start = np.array([0, 1500, 1502, 4000])
    pair = words[:-1] * 6 + words[1:]
    ids, first, of = np.unique(pair, return_index=True, return_inverse=True)
    triple, at, n3 = np.unique(pair[:-1] * 6 + words[2:], return_index=True, return_counts=True)
    m = lm.Automaton(np.bincount(words), words[first], words[first + 1], np.bincount(of), of[at], of[at + 1], words[at + 2], np.where(n3 > 1, n3, 0), 4000.0)
    whole = [np.sort(x) for x in m.read(words, start)]
    monkeypatch.setattr(lm, "SEGMENT", 5)
    for a, b in zip(whole, m.read(words, start), strict=True):
        assert np.allclose(a, np.sort(b))


def test_packed_numbers_come_back():
    import numpy as np

    for values, kind in ((np.zeros(0, np.uint64), "<u8"), (np.array([1, 2**63, 5], np.uint64), "<u8"), (np.arange(1000), "<u4"), (np.array([True, False]), "u1")):
        assert np.array_equal(tb.unpacked(tb.packed(values, kind), kind), values)


def test_rare_ngrams_stay_in_a_large_corpus(spark):
    """Three occurrences among 400,000 tokens, and one very long text."""
    hold_against_brute(spark, [(1, "a " * 400_000), *((i, "p q r s") for i in (2, 4, 5)), (3, "p q r s"), (6, "q r"), (9, "s r q p")])


def test_empty_tables_and_further_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(none, F.lit(True)).collect() == []
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, None, None, "y"), (None, "a", 1, None)], "doc_id long, text string, score int, block string")
    one = lm.score(docs, F.lit(False)).collect()
    assert sorted(((r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens) for r in one) == [(0, 2, 0, 0), (1, 3, 0, 0), (2, 1, 0, 0)] and all(math.isfinite(r.score) for r in one)


def test_held_out_texts_score_higher_with_more_to_learn_from(spark):
    """A text of the larger table's held-out fold, scored by what is learned from a tenth of its rows and from all."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    held = fold_of("doc_id", 10) == 0
    less = lm.score(docs, ~held & (fold_of("doc_id", 7) == 0)).where(held).agg(F.sum("score")).first()[0]
    more = lm.score(docs, ~held).where(held).agg(F.sum("score"), F.sum("base_score")).first()
    assert more[0] > less and more[0] > more[1]
