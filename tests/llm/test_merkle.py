"""The Merkle manifest against its definition in plain Python, and against SQL."""

import random
import zlib
from hashlib import sha256
from itertools import groupby

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import merkle, registry


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def path(tree, i, arity):
    steps = []
    for level in tree[:-1]:
        first = i - i % arity
        steps.append(("".join(level[first:i]), "".join(level[i + 1 : first + arity])))
        i //= arity
    return steps


def plain(rows, arity=2):
    """For each (doc_id, source, lang, n_chars, text), sorted: leaf, subroot, root, proof."""
    keyed = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [(k, list(g)) for k, g in groupby(keyed, key=lambda r: r[2])]
    trees = [levels([leaf(r) for r in g], arity) for _, g in groups]
    top = levels([t[-1][0] for t in trees], arity)
    return [(r, leaf(r), t[-1][0], top[-1][0], path(t, i, arity) + path(top, j, arity)) for j, ((_, g), t) in enumerate(zip(groups, trees, strict=True)) for i, r in enumerate(g)]


def expected(rows):
    out = []
    for r, d, subroot, root, proof in plain(rows):
        tampered = zlib.crc32(str(r[0]).encode()) % 7 == 0 if r[0] is not None else True
        again = leaf((*r[:3], r[3] + 1, r[4])) if tampered and r[3] is not None else d
        for before, after in proof:
            again = h(before, again, after)
        out.append((r[0], d, subroot, root, h(*[x for step in proof for x in step]), again, again == root))
    return out


def some_rows(n, seed, langs):
    r = random.Random(seed)
    return [(i, f"s{i % 3}", r.choice(langs), None if i % 11 == 0 else i, r.choice(["", "é", None, "x" * (i % 50)])) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 2, 3, 700])
def test_query_equals_the_definition(spark, tmp_path, n):
    rows = some_rows(n, n, ["en"] * 6 + ["de", None, "ß", "fr", "only" if n > 3 else "en"])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["op11_merkle"](spark, str(tmp_path)).collect())
    assert got == sorted(expected(rows))
    assert n < 700 or {r[-1] for r in got} == {True, False}


def test_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{small}/documents.parquet'")
    got = registry.QUERIES["op11_merkle"](spark, small)
    want = con.sql(registry.ORACLES["op11_merkle"])
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_other_arities_and_several_rounds(spark, monkeypatch, arity):
    """Small limits, so that the frontier is dealt several times and proofs go through several bands."""
    monkeypatch.setattr(merkle, "DEALT", arity**2)
    monkeypatch.setattr(merkle, "BLOCK", arity**2)
    rows = some_rows(500, arity, ["en"] * 8 + ["de", None])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = merkle.manifest(docs.withColumn("leaf", merkle.leaf_of(*[F.col(c) for c in docs.columns])), "leaf", "lang", ["doc_id"], arity)
    got = {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], [tuple(s.split("|")) for s in r["proof"]]) for r in out.collect()}
    assert got == {r[0]: (d, s, t, p) for r, d, s, t, p in plain(rows, arity)}
    assert out.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_events_in_any_order_give_the_same_nodes(monkeypatch):
    leaves = [h(str(i)) for i in range(77)]
    whole = {(level, i): d for level, nodes in enumerate(levels(leaves, 2)) for i, d in enumerate(nodes) if level}

    def run(order, batch):
        rows = [("g", 77, 0, i, leaves[i]) for i in order]
        given = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + batch], strict=True)], names=["k", "n", "level", "i", "d"]) for a in range(0, len(rows), batch)]
        out = [tuple(r.values()) for b in merkle.fold(iter(given), 2) for r in b.to_pylist()]
        return {(level, i): d for _, _, level, i, d, made, _ in out if made}, [r for r in out if r[-1]]

    order = list(range(77))
    assert run(order, 10) == (whole, [])
    random.Random(1).shuffle(order)
    assert run(order, 7) == (whole, [])
    made, frontier = run(range(5, 60), 9)
    assert made.items() <= whole.items() and 0 < len(frontier) < 16
    monkeypatch.setattr(merkle, "PARTIAL", 3)
    made, frontier = run(order, 7)
    assert made.items() <= whole.items() and frontier


def test_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, names that clash, a long text, no rows."""
    rows = [(None, None, None, None, None), (None, "a", None, 1, ""), (5, "a", "en", 2, "t"), (5, "a", "en", 2, "t"), (5, "b", "en", 2, "t"), (6, "a", "en", 2, "x" * 3_000_000)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS k", "2 AS n", "3 AS i", "4 AS d", "5 AS root", "6 AS carried", "7 AS __row")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in registry.QUERIES["op11_merkle"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(expected(rows), key=str)
    out = merkle.manifest(docs.drop("text").withColumn("leaf", merkle.leaf_of(F.col("doc_id"))), "leaf", "lang", ["doc_id"])
    assert out.columns == ["doc_id", "source", "lang", "n_chars", "k", "n", "i", "d", "carried", "__row", "leaf", "position", "subroot", "root", "proof"]
    assert out.where("k <> 1 OR n <> 2 OR i <> 3 OR d <> 4 OR carried <> 6").count() == 0
    assert merkle.manifest(docs.where("doc_id > 9").withColumn("leaf", F.lit("x")), "leaf", "lang", ["doc_id"]).collect() == []
