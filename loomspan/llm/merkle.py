"""Merkle manifest of a dataset: a digest for each row, group and the whole, with proofs.

Rows of a group are leaves in a given order; ``arity`` consecutive nodes at a time (the
last run may be shorter) become their parent until one is left, the group's subroot.
Subroots in order of their group (null first) become the root in the same way.

The tree is folded by events. A task keeps partial parents, which gather the digests of
their children by place as rows come, in any order and from any part of the table. How
many children a parent has follows from the group's size alone; when they are there the
parent is made, and is at once an event for its own parent. What is left at the end of
a task, a few nodes at the ends of each stretch of leaves, is the frontier: it is dealt
anew by the ancestor some ten levels up and folded again, until no frontier is left.
Proofs go down again by the reverse links: nodes are read in blocks of eight levels,
and each node's path to the root is its own siblings before its parent's path.

Defined results: null values have a mark of their own; rows without an order value come
first, rows of the same order value ascend by digest; repeated rows are leaves of their
own. A group of one row has its leaf as subroot. An empty table gives no rows. Columns
of the given rows are carried along whatever their names, so give only small ones; of
the columns that are added those of the same name are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import Scratch, fold_of, settle, table

#: Most children that one dealing of the frontier brings to an ancestor, and most bottom nodes of a proof block.
DEALT, BLOCK = 1024, 256
#: Partial parents of a task; beyond it they go to the frontier.
PARTIAL = 1 << 16
#: Rows of an output batch.
ROWS = 1 << 13
_NODE = "k string, n long, level int, i long, d string, made boolean, open boolean"


def leaf_of(*values: Column) -> Column:
    """Digest of a row's values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def digest_of(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _span(arity: int, most: int) -> int:
    """Levels that bring at most so many nodes to one ancestor."""
    span = 1
    while arity ** (span + 1) <= most:
        span += 1
    return span


def _power(arity: int, exponent: Column, most: int) -> Column:
    """arity to the power of exponent (at most most) in whole numbers."""
    out = F.lit(1).cast("long")
    for k in range(1, most + 1):
        out = F.when(exponent >= k, F.lit(arity**k)).otherwise(out)
    return out


def _ancestor(arity: int, exponent: Column, most: int) -> Column:
    """The place of a node's ancestor so many levels up."""
    return F.floor(F.col("i") / _power(arity, exponent, most))


def fold(batches: Iterator[pa.RecordBatch], arity: int) -> Iterator[pa.RecordBatch]:
    """Parents of the nodes that come, as soon as all their children are there; then the frontier."""
    partial: dict[tuple, dict[int, str]] = {}
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "n", "level", "i", "d", "made", "open"])

    def frontier() -> None:
        for (k, n, level, _), children in partial.items():
            out.extend((k, n, level, i, d, False, True) for i, d in children.items())
        partial.clear()

    for given in batches:
        for k, n, level, i, d in zip(*(given.column(c).to_pylist() for c in ("k", "n", "level", "i", "d")), strict=True):
            here = -(-n // arity**level)
            while here > 1:
                parent = i // arity
                children = partial.setdefault((k, n, level, parent), {})
                children[i] = d
                if len(children) < min(arity, here - arity * parent):
                    break
                d = digest_of([children[c] for c in sorted(children)])
                del partial[k, n, level, parent]
                i, level, here = parent, level + 1, -(-here // arity)
                out.append((k, n, level, i, d, True, False))
            if len(partial) > PARTIAL:
                frontier()
            if len(out) > ROWS:
                yield batch()
    frontier()
    yield batch()


class _Tree:
    """All groups' leaves with their places, and the nodes above them."""

    def __init__(self, scratch: Scratch, leaves: DataFrame, arity: int):
        """leaves: group key k, order value o, digest d, and a struct of what is carried. The tables of the tree stay, as its proofs read them."""
        self.arity = arity
        # a number of its own for each row, so that equal rows can be dealt over tasks
        held = scratch.settle(leaves.withColumn("s", F.monotonically_increasing_id()))
        placed = held.repartitionByRange("k", "o", "d", "s").sortWithinPartitions("k", "o", "d", "s").withColumn("place", F.monotonically_increasing_id())
        placed = scratch.settle(placed.select("k", "d", "carried", "place", F.shiftright("place", 33).alias("part")))
        runs = placed.groupBy("k", "part").agg(F.count(F.lit(1)).alias("m"), F.min("place").alias("first"))
        before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select("k", "part", (F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(Window.partitionBy("k")).alias("n"))
        self.leaves = settle(placed.join(runs, ["k", "part"]).select("k", "n", (F.col("place") + F.col("shift")).alias("i"), "d", "carried"))
        self.most = self.leaves.agg(F.max("n")).first()[0] or 0
        height = 0
        while arity**height < self.most:
            height += 1
        self.nodes = self._folded()
        alone = self.leaves.where("n = 1").select("k", "n", "d")
        top = self.nodes.where((F.col("i") == 0) & (F.col("n") <= _power(arity, F.col("level"), height))).select("k", "n", "d")
        self.roots = settle(alone.unionByName(top))

    def _folded(self) -> DataFrame:
        arity, span = self.arity, _span(self.arity, DEALT)
        step = lambda df: df.mapInArrow(lambda batches: fold(batches, arity), _NODE)
        found = settle(step(self.leaves.select("k", "n", F.lit(0).alias("level"), "i", "d")))
        made, front, top = found.where("made"), found.where("open"), span
        while arity ** (top - span) < self.most:
            low = front.where(F.col("level") < top)
            dealt = low.repartition("k", _ancestor(arity, top - F.col("level"), span)).sortWithinPartitions("k", F.col("i") * _power(arity, F.col("level"), top))
            found = settle(step(dealt.select("k", "n", "level", "i", "d")))
            made, front = made.unionByName(found.where("made")), front.where(F.col("level") >= top).unionByName(found.where("open"))
            top += span
        return made.select("k", "n", "level", "i", "d")

    def proofs(self, above: DataFrame) -> DataFrame:
        """leaves with the group's subroot and each one's path, to which above (k, path, subroot) adds the subroots' own."""
        arity, span = self.arity, _span(self.arity, BLOCK)
        bands = 1
        while arity ** (bands * span) < self.most:
            bands += 1
        kinds = {f.name: f for f in self.leaves.schema}
        more = [StructField("path", ArrayType(StringType())), StructField("subroot", StringType())]
        tops = self.roots.select("k", "n").join(above, "k").withColumn("block", F.lit(0).cast("long"))
        paths = None
        for b in reversed(range(bands)):
            low, high = b * span, (b + 1) * span
            inside = self.nodes.where((F.col("level") >= max(low, 1)) & (F.col("level") < high) & (F.col("n") > (arity**low if b else 0)))
            inside = inside.withColumn("carried", F.lit(None).cast(kinds["carried"].dataType)) if b == 0 else inside
            if b == 0:
                inside = inside.unionByName(self.leaves.withColumn("level", F.lit(0)))
            inside = inside.withColumn("block", _ancestor(arity, high - F.col("level"), span))
            own = tops.where((F.col("n") <= arity**high) & (F.col("n") > (arity**low if b else 0))).select("k", "block", "path", "subroot")
            given = own if paths is None else own.unionByName(paths.select("k", F.col("i").alias("block"), "path", "subroot"))
            names = ["k", "i", "n", "d", *(["carried"] if b == 0 else [])]
            schema = StructType([kinds[c] for c in names] + more)
            step = _reverse(arity, low, high, names)
            paths = inside.groupBy("k", "block").cogroup(given.groupBy("k", "block")).applyInArrow(step, schema)
        return paths


def _reverse(arity: int, low: int, high: int, names: list[str]):
    """A function that gives each bottom node of a block the path to the root, from the block's nodes and its top's path."""

    def step(nodes: pa.Table, above: pa.Table) -> pa.Table:
        bottom = nodes.filter(pc.equal(nodes["level"], low))
        kept = bottom.select(names)
        if not bottom.num_rows:
            return kept.append_column("path", pa.array([], pa.list_(pa.string()))).append_column("subroot", pa.array([], pa.string()))
        n = nodes["n"][0].as_py()
        path, subroot = above["path"][0].as_py(), above["subroot"][0].as_py()
        tree = {(level, i): d for level, i, d in zip(*(nodes[c].to_pylist() for c in ("level", "i", "d")), strict=True)}
        known: dict[tuple[int, int], list[str]] = {}
        for level, i in sorted(tree, reverse=True):
            here = -(-n // arity**level)
            first = i - i % arity
            beside = range(first, min(first + arity, here))
            own = [] if here == 1 else ["|".join(("".join(tree[level, c] for c in beside if c < i), "".join(tree[level, c] for c in beside if c > i)))]
            known[level, i] = own + known.get((level + 1, i // arity), path)
        column = pa.array([known[low, i] for i in bottom["i"].to_pylist()], pa.list_(pa.string()))
        return kept.append_column("path", column).append_column("subroot", pa.array([subroot] * bottom.num_rows, pa.string()))

    return step


def manifest(rows: DataFrame, leaf: str, group: str, order: list[str], arity: int = 2) -> DataFrame:
    """rows with position (in the group, from 0), subroot, root and proof.

    leaf names the column of the rows' digests. A proof has a step for each parent on
    the way to the root: the digests before and after the node in its run, with ``|``
    between.
    """
    taken = [c for c in rows.columns if c not in ("position", "subroot", "root", "proof")]
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(key.alias("k"), F.struct(*order).alias("o"), F.col(leaf).alias("d"), F.struct(*taken).alias("carried"))
    with Scratch(rows.sparkSession) as scratch:
        tree = _Tree(scratch, leaves, arity)
        over = _Tree(scratch, tree.roots.select(F.lit("").alias("k"), F.struct("k").alias("o"), "d", F.struct("k").alias("carried")), arity)
        top = over.roots.first()
        ends = over.roots.select("k", F.array().cast("array<string>").alias("path"), F.col("d").alias("subroot"))
        groups = over.proofs(ends).select(F.col("carried.k").alias("k"), "path", F.col("d").alias("subroot"))
        out = tree.proofs(groups).select("carried.*", F.col("i").alias("position"), "subroot", F.lit(top["d"] if top else None).cast("string").alias("root"), F.col("path").alias("proof"))
        return out


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda d, step: F.sha2(F.concat(F.substring_index(step, "|", 1), d, F.substring_index(step, "|", -1)), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and whether the root still follows after tampering with some."""
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    whole = leaf_of(*parts)
    changed = F.when(fold_of("doc_id", 7) == 0, leaf_of(*parts[:3], F.col("n_chars") + 1, parts[4])).otherwise(whole)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", whole.alias("leaf"), changed.alias("changed"))
    out = manifest(rows, "leaf", "lang", ["doc_id"])
    digest = F.sha2(F.translate(F.array_join("proof", ""), "|", ""), 256)
    again = out.withColumns({"proof_sha256": digest, "folded_root": folded(F.col("changed"), F.col("proof"))})
    return again.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same by recursion over levels; crc32 bit by bit, as DuckDB has none.
ORACLE = """
WITH RECURSIVE
docs AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS h
  FROM documents),
leaves AS (
  SELECT doc_id, lang, head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail AS whole,
    head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail AS other, xor(h, 4294967295) % 7 = 0 AS tampered
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
          coalesce(strlen(text) || ':' || text, '-') AS tail FROM docs)),
placed AS (
  SELECT doc_id, lang, sha256(whole) AS leaf, sha256(CASE WHEN tampered THEN other ELSE whole END) AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(whole)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
nodes(lang, level, i, n, d) AS (
  SELECT lang, 0, i, n, leaf FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n),
subroots AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper(level, i, n, d) AS (
  SELECT 0, i, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 2, n),
up(doc_id, lang, leaf, level, i, n, d, proof) AS (
  SELECT doc_id, lang, leaf, 0, i, n, changed, '' FROM placed
  UNION ALL
  SELECT u.doc_id, u.lang, u.leaf, u.level + 1, u.i // 2, (u.n + 1) // 2,
    sha256(CASE WHEN s.d IS NULL THEN u.d WHEN u.i % 2 = 1 THEN s.d || u.d ELSE u.d || s.d END), u.proof || coalesce(s.d, '')
  FROM up u LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM u.lang AND s.level = u.level AND s.i = xor(u.i, 1) WHERE u.n > 1),
over_groups(doc_id, lang, leaf, level, i, n, d, proof) AS (
  SELECT u.doc_id, u.lang, u.leaf, 0, s.i, s.n, u.d, u.proof FROM up u JOIN subroots s ON s.lang IS NOT DISTINCT FROM u.lang WHERE u.n = 1
  UNION ALL
  SELECT u.doc_id, u.lang, u.leaf, u.level + 1, u.i // 2, (u.n + 1) // 2,
    sha256(CASE WHEN s.d IS NULL THEN u.d WHEN u.i % 2 = 1 THEN s.d || u.d ELSE u.d || s.d END), u.proof || coalesce(s.d, '')
  FROM over_groups u LEFT JOIN upper s ON s.level = u.level AND s.i = xor(u.i, 1) WHERE u.n > 1)
SELECT o.doc_id, o.leaf, s.subroot, r.d AS root, sha256(o.proof) AS proof_sha256, o.d AS folded_root, o.d = r.d AS verified
FROM over_groups o JOIN subroots s ON s.lang IS NOT DISTINCT FROM o.lang JOIN upper r ON r.n = 1 WHERE o.n = 1
"""
