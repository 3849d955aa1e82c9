"""Every stage on its own input: rows, columns and decisions."""

import re

import corpus_pipeline
import pytest
from test_jaccard import brute

from loomspan.llm import decontaminate, jaccard, pii, quality
from loomspan.llm.common import table


def test_stages(spark, small):
    docs = table(spark, small, "documents").cache()
    labels = table(spark, small, "labels").select("doc_id", "quality")
    kept = corpus_pipeline.quality_stage(spark, docs, small)
    scored = {r["doc_id"]: r["score"] for r in quality.predict(docs, quality.fit(docs, labels)).collect()}
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, s in scored.items() if s >= 0.5}
    once = corpus_pipeline.dedup_stage(spark, docs, small)
    groups = jaccard.join(docs, 5, 80, 100).collect()
    assert sorted(r["doc_id"] for r in once.collect()) == sorted({r["component_id"] for r in groups})
    clean = corpus_pipeline.decontaminate_stage(spark, docs, small)
    hit = {r["doc_id"] for r in decontaminate.matches(docs, table(spark, small, "benchmark")).collect()}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in hit)
    hidden = corpus_pipeline.pii_stage(spark, docs, small)
    rows = {r["doc_id"]: r for r in hidden.collect()}
    assert hidden.columns == docs.columns and len(rows) == docs.count()
    for r in docs.collect():
        if r["text"] is not None and not pii.fixed_spans(r["text"]):
            continue
        if r["text"] is not None:
            assert not [s for s in pii.fixed_spans(rows[r["doc_id"]]["text"]) if s[0] == "email"]
            assert rows[r["doc_id"]]["n_chars"] == len(rows[r["doc_id"]]["text"])


def test_near_duplicates_against_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    docs = spark.createDataFrame([(i, t, "l", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {c for _, _, c in brute(rows, 5, 80, 100)}
    assert {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, small).collect()} == want


def test_decontamination_drops_every_verbatim_item(spark, small):
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [words(r["text"]) for r in table(spark, small, "benchmark").collect()]
    docs = table(spark, small, "documents")
    holds = {r["doc_id"] for r in docs.collect() if any(len(x.split()) >= 5 and x in words(r["text"]) for x in items)}
    kept = {r["doc_id"] for r in corpus_pipeline.decontaminate_stage(spark, docs, small).collect()}
    assert holds and not holds & kept and len(kept) > 0.8 * docs.count()


ODD = [(1, None, None, None, None, 5, "k"), (1, None, None, None, None, 5, "k"), (None, "a b c d e f", "en", "s", 11, None, None), (2, "", "en", "s", 0, 1, "k"), (3, "word " * 40_000, "en", "s", 200_000, 1, "k"), (4, "mail me at a@b.example now please", "en", None, 33, 1, "k"), (4, "another text of the same id", "en", None, 27, 1, "k")]


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows_and_clashing_columns_go_through_every_stage(spark, small, empty):
    docs = spark.createDataFrame([] if empty else ODD, "doc_id long, text string, lang string, source string, n_chars long, score int, key string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        rows = out.collect()
        assert len(rows) == 0 if empty else len(rows) <= len(ODD)
        if name == "near_duplicates" and not empty:
            assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "3", "4", "4", "None"]
        if name == "pii" and not empty:
            assert [r["text"] for r in rows if r["doc_id"] == 4 and "mail" in r["text"]] == ["mail me at <EMAIL> now please"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.count() == (0 if empty else sum(r["length"] > 0 for r in packed.collect()))


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0
