"""Language, quality and toxicity: held-out accuracy, and the defined results of odd rows."""

import pytest
from pyspark.sql import functions as F

from loomspan.llm import langid, quality, toxicity
from loomspan.llm.common import fold_of, table

ODD = [(900001, None), (900002, ""), (900003, "12 34 !?"), (900004, "word " * 30000), (None, "a b c"), (900004, "word " * 30000)]


def _auc(rows):
    rows = sorted(rows)
    good = sum(y for _, y in rows)
    total, i = 0.0, 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        total += sum(y for _, y in rows[i:j]) * (i + j + 1) / 2
        i = j
    return (total - good * (good + 1) / 2) / (good * (len(rows) - good))


def test_language_held_out(spark):
    got = langid.op5_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows = got.where("held_out and lang is not null and n_chars > 40 and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.93 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "labels").where("quality is not null").select("doc_id", "quality")
    rows = quality.op6_quality(spark, folder).where("held_out").join(labels, "doc_id").collect()
    assert _auc([(r["score"], r["quality"]) for r in rows]) > 0.85
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(fold_of("doc_id", 3) != 1))
    held = labels.where((fold_of("doc_id", 3) == 1) & F.col("toxic").isNotNull()).withColumnRenamed("toxic", "y")
    rows = toxicity.predict(docs, model).join(held, "doc_id").collect()
    assert _auc([(r["severity"], r["y"]) for r in rows]) > 0.85
    assert all(0 <= r["severity"] <= 3 for r in rows)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, ("good plain text of some words " if i % 2 else "zzq xxv bad junk ") * (3 + i % 5), i % 2, "x", 1.0) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 7, "clash") for i, t, *_ in rows] + [(i, t, None, None) for i, t in ODD], "doc_id long, text string, score int, lang string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y, *_ in rows] + [(0, None, None), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_odd_rows(spark, odd):
    docs, labels = odd
    scored = quality.predict(docs, quality.fit(docs, labels)).collect()
    assert len(scored) == 66 and all(0 <= r["score"] <= 1 for r in scored)
    by_text = {}
    assert all(by_text.setdefault(r["text"], r["score"]) == r["score"] for r in scored)
    severe = toxicity.predict(docs, toxicity.fit(docs, labels)).collect()
    assert len(severe) == 66 and all(0 <= r["severity"] <= 3 and r["grade"] in (0, 1, 2, 3) for r in severe)
    named = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs.where("lang is not null"))).collect()}
    assert all(named[i]["lang_pred"] == "und" and named[i]["score"] == 0 for i in (900001, 900002, 900003))
    assert named[1]["lang_pred"] == "clash"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert quality.predict(docs, quality.fit(docs, labels)).count() == 0
    assert quality.predict(some, quality.fit(docs, labels)).first()["score"] == 0.5
    assert toxicity.predict(some, toxicity.fit(docs, labels)).first()["grade"] == 0
    assert langid.predict(some, langid.fit(docs)).first()["lang_pred"] == "und"


def test_language_posterior_against_plain_counts(spark):
    """Counts and posteriors of character n-grams with dictionaries."""
    import math
    from collections import Counter, defaultdict

    import numpy as np

    learned = [("der Bär hört die Ähre", "de"), ("ÇA va très bien là-bas", "fr"), ("the bear 12 hears", "en"), ("日本語の文です", "ja"), ("я слышу медведя", "ru"), ("the the", "en")]
    asked = [(1, "die Ähren"), (2, "là très"), (3, "日本の文"), (4, "МЕДВЕДЬ"), (5, "12"), (6, "bear")]

    def grams(text):
        one = "".join(c if not c.isascii() or c.isalpha() else " " for c in text.lower())
        return Counter(one[i : i + n] for n in langid.ORDERS for i in range(len(one) - n + 1) if one[i : i + n].strip())

    def bucket(gram):
        raw = np.frombuffer(gram.encode(), np.uint8)
        (found,) = [b for b, _ in langid.ngram_buckets(raw, np.array([0, len(raw)])) if len(b) == 1][-1]
        return int(found)

    counts, texts = defaultdict(Counter), Counter(lang for _, lang in learned)
    for text, lang in learned:
        for g, n in grams(text).items():
            counts[lang][bucket(g)] += n
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), langid.fit(spark.createDataFrame(learned, "text string, lang string"))).collect()}
    for i, text in asked:
        own = grams(text)
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        logs = {}
        for lang in counts:
            whole = sum(counts[lang].values()) + 0.5 * langid.BUCKETS
            logs[lang] = math.log(texts[lang] / len(learned)) + sum(n * math.log((counts[lang][bucket(g)] + 0.5) / whole) for g, n in own.items())
        best = max(logs, key=logs.get)
        share = 1 / sum(math.exp((x - logs[best]) / math.sqrt(sum(own.values()))) for x in logs.values())
        assert got[i].lang_pred == best and got[i].score == pytest.approx(share, abs=1e-4)


def test_many_languages(spark):
    rows = [(f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 5, f"l{i:03}") for i in range(300)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.logp.size <= langid.BUCKETS * langid.MOST_LANGUAGES
    got = langid.predict(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"), model).collect()
    assert sum(r.lang_pred == rows[r.doc_id][1] for r in got) > 290


def test_random_indexing_and_pooling_against_plain_loops(spark):
    import numpy as np

    texts = ["a b c a", "b a", "", "x y", "long " * 40]
    place, sign = quality.random_vectors()
    vector = {b: np.zeros(quality.DIMS) for b in range(quality.BUCKETS)}
    for b in range(quality.BUCKETS):
        for j in range(quality.NONZERO):
            vector[b][place[b, j]] += sign[b, j]
    sums = {}
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        own, _ = quality.tokens(raw, np.array([0, len(raw)]))
        for i, b in enumerate(own):
            total = sums.setdefault(int(b), [0, np.zeros(quality.DIMS)])
            total[0] += 1
            for k in range(max(0, i - quality.WINDOW), min(len(own), i + quality.WINDOW + 1)):
                if k != i:
                    total[1] += vector[int(own[k])]
    got = quality.context_sums(spark.createDataFrame([(t,) for t in texts], "text string")).toPandas()
    assert {int(r.bucket): int(r.n) for r in got.itertuples()} == {b: n for b, (n, _) in sums.items()}
    for r in got.itertuples(index=False):
        assert list(r)[2:] == sums[int(r.bucket)][1].astype(int).tolist()
    vectors = np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    rows = quality.pooled(vectors, raw, bounds)
    for i, t in enumerate(texts):
        piece = np.frombuffer(t.encode(), np.uint8)
        own, _ = quality.tokens(piece, np.array([0, len(piece)]))
        if not len(own):
            assert not rows[i].any()
            continue
        x = vectors[own]
        assert np.allclose(rows[i][: quality.DIMS], 4 * x.mean(axis=0), atol=1e-4)
        assert np.allclose(rows[i][quality.DIMS : 2 * quality.DIMS], 4 * x.std(axis=0), atol=2e-2)


def test_cumulative_link_gradient_against_differences():
    """The slopes of the mean negative log-likelihood, by finite differences of its definition."""
    import numpy as np

    r = np.random.default_rng(2)
    linear, t, grade = r.normal(size=9), np.array([-0.5, 0.4, 1.5]), r.integers(0, 4, 9)

    def loss(linear, t):
        above = lambda j, x: 1.0 if j == 0 else 0.0 if j == 4 else 1 / (1 + np.exp(t[j - 1] - x))
        return -np.mean([np.log(above(g, x) - above(g + 1, x)) for g, x in zip(grade, linear, strict=True)])

    _, per, by_threshold = toxicity._gradient(linear, t, grade, np.arange(9))
    for i in range(9):
        step = np.eye(9)[i] * 1e-6
        assert -per[i] == pytest.approx((loss(linear + step, t) - loss(linear - step, t)) / 2e-6, abs=1e-6)
    for j in range(3):
        step = np.eye(3)[j] * 1e-6
        assert by_threshold[j] == pytest.approx((loss(linear, t + step) - loss(linear, t - step)) / 2e-6, abs=1e-6)


def test_grades_follow_severity_and_the_sample_is_bounded(spark):
    """Texts with more of what is toxic get a higher grade; a small bound in features still learns."""
    rows = [(i, "plain words of text " * 6 + ("vile " * (1 + i % 9) if i % 2 else ""), i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    for model in (toxicity.fit(docs, labels), toxicity.fit(docs, labels, features_in_all=1500)):
        got = {r.doc_id: r.severity for r in toxicity.predict(docs, model).collect()}
        assert min(got[i] for i, _, y in rows if y) > max(got[i] for i, _, y in rows if not y)
        assert got[17] > got[9]  # nine times against once
