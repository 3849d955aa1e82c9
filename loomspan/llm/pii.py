"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction.

The fixed patterns find e-mail addresses, IP addresses, card and phone numbers. What
they find are seed entities, and so are words that meet a pattern on their own but stand
in a longer run of digits that doesn't. The one and two whole words before an entity, and
those after it, are lexical patterns; other strings of an identifier's shape are unproved
instances. An instance is trusted by its value: what is a seed anywhere is one everywhere.
Spark scores the graph of patterns and instances in rounds:

- every instance trusted so far brings in its contexts as patterns, seeds and found ones
  alike; the places where a new pattern's words stand are counted over all texts;
- a pattern's confidence for a kind is the trusted share of those places (so common
  words are never confident), copies counted on both sides, and it needs a minimum of
  distinct instances;
- an instance's trust is 1 - prod(1 - confidence) over its patterns.

It ends when a round brings no new pattern and changes none's confidence. Instances beside patterns that end up
confident, and those with a seed's value, become spans of that kind, where they overlap
no fixed one: a last scan of the texts looks the contexts up in the confident patterns, broadcast
in blocks of at most about MOST_PATTERNS. No text is shuffled. Bitmaps of fixed size tell which
words are worth counting.

Defined results: null and empty texts have no spans and empty span strings; their
digest is that of the empty string. Repeated rows get equal results, each a row, and
change no other row's. Of two patterns of equal confidence the kind listed first counts. Further
columns are ignored by ``detect`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import Scratch, fresh, table

KINDS = ("email", "ip", "card", "phone")
#: Patterns of a broadcast: 13 bytes each.
MOST_PATTERNS = 1 << 19
MIN_INSTANCES = 4.0
MIN_CONFIDENCE = 0.5
#: The rounds end when no pattern is new and none's confidence changes by this much.
SETTLED = 0.01
BITMAP_BITS = 22

# The patterns of the four kinds. The address is matched around each @;
# a look-behind and a possessive run keep long digit runs from being tried at every place.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"\x20?[\[(]at[\])]\x20?", re.I)
_SPELT = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)+", re.I)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_REACH = 400
_SPACES = frozenset(" \t\n\v\f\r")
_WORTH = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
_EDGE = "\"'`.,;:!?()[]{}<>|#$%&*=~"
_FOLD = tb.LOWER.copy()
_FOLD[48:58] = 48


def _before(text: str, end: int, least: int) -> int:
    start = end
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    return start


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) << (k & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; in code points, end exclusive."""
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = _before(text, at, done)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdecimal() for c in m[0]) <= 15]
    return out


def unproved(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(shape, start, end) of identifier-like strings that overlap no taken span: spelt-out addresses, and words of 6 or more characters with 5 or more digits."""
    out = []
    for m in _AT.finditer(text):
        start = _before(text, m.start(), 0)
        if start < m.start() and (n := _SPELT.match(text, m.end())):
            out.append(("email", start, n.end()))
    for m in _WORD.finditer(text):
        word = m[0]
        bare = word.strip(_EDGE)
        if len(bare) >= 6 and sum(c in "0123456789" for c in bare) >= 5:
            start = m.start() + len(word) - len(word.lstrip(_EDGE))
            out.append(("number", start, start + len(bare)))
    clear, busy = [], sorted([(a, b, "") for _, a, b in taken] + [(a, b, shape) for shape, a, b in out], key=lambda x: (x[0], x[2] != "", -x[1]))
    # in order of start, an instance is clear if nothing before reaches into it and no fixed span begins in it
    fixed = [a for a, _, shape in busy if not shape]
    reach = k = 0
    for a, b, shape in busy:
        while k < len(fixed) and fixed[k] < a:
            k += 1
        if not shape:
            reach = max(reach, b)
        elif a >= reach and (k == len(fixed) or fixed[k] >= b):
            clear.append((shape, a, b))
            reach = b
    return clear


_SALTS = tuple(tb.U64(x) for x in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0xD1342543DE82EF95, 0x9FB21C651E98DF25))
#: What tells a value apart from a context of the same hash.
_VALUE_SALT = 0x3C6EF372FE94F82B


def contexts(text: str, start: int, stop: int) -> list[int]:
    """Hashes of the whole word before a span, of the two before it, of the one after it and of the two after it (within _REACH characters)."""
    low, high = max(0, start - _REACH), min(len(text), stop + _REACH)
    while start > low and text[start - 1] not in _SPACES:  # a word that holds the span is no context
        start -= 1
    while stop < high and text[stop] not in _SPACES:
        stop += 1
    before, after = list(_WORD.finditer(text, low, start))[-2:], list(islice(_WORD.finditer(text, stop, high), 2))
    # words that the reach cuts off are none
    before = [m[0] for m in before if m.start() > low or low == 0]
    after = [m[0] for m in after if m.end() < high or high == len(text)]
    return [*(_side("\n".join(before), 0) if before else ()), *(_side("\n".join(after), 2) if after else ())]


@lru_cache(1 << 14)
def _side(words: str, one: int) -> tuple[int, ...]:
    """Hashes of the one and the two words on a side; the nearest is the last one before a span, the first one after it."""
    raw = np.frombuffer(words.encode("utf-8", "surrogatepass"), np.uint8)
    single, double = _context_hashes(*tb.words(_FOLD[raw], np.array([0, len(raw)])))
    return int((single[[0 if one else -1]] ^ _SALTS[one]).view(np.int64)[0]), *((double ^ _SALTS[one + 1]).view(np.int64).tolist())


def _context_hashes(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and of each two neighbours in a row."""
    near = row[1:] == row[:-1]
    return tb.mix(h), tb.mix(h[:-1][near] * tb.U64(0x2545F4914F6CDD1D) + h[1:][near])


@lru_cache(1 << 14)
def _value(text: str) -> int:
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    return int(tb.Prefix(raw).of(np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind or shape, start, end, whether a fixed pattern found it); texts without digit and @ need no search."""
    if not _WORTH.search(text):
        return []
    seeds = fixed_spans(text)
    return [(*x, True) for x in seeds] + [(*x, False) for x in unproved(text, seeds)]


def _instances(text: str) -> Iterator[tuple[str, int, int, bool, bool]]:
    """spans, with those unproved ones that meet a pattern by themselves as seeds of its kind; and whether it was so."""
    for shape, a, b, seed in spans(text):
        own = [] if seed else fixed_spans(text[a:b])
        alone = len(own) == 1 and own[0][1:] == (0, b - a)
        yield (own[0][0] if alone else shape), a, b, seed or alone, alone


def edges(docs: DataFrame, text: str = "text") -> DataFrame:
    """(context, value, kind, seed, alone, n): how often each instance stands beside each context; kind is the shape where it is no seed. alone: a seed that no fixed pattern finds in its text. An instance without contexts has one of its value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, int] = {}
            for one in batch.column(0):
                body = one.as_py() or ""
                for kind, start, stop, seed, alone in _instances(body):
                    value = _value(body[start:stop])
                    for context in contexts(body, start, stop) or [value ^ _VALUE_SALT]:
                        key = context, value, kind, seed, alone
                        held[key] = held.get(key, 0) + 1
            columns = list(zip(*((*k, n) for k, n in held.items()), strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["context", "value", "kind", "seed", "alone", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tb.tidy(rows), "context long, value long, kind string, seed boolean, alone boolean, n long")
    return found.groupBy("context", "value", "kind", "seed", "alone").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, patterns: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """(context, total): how often each pattern's words stand in all texts."""
    slot = F.shiftrightunsigned("context", 64 - BITMAP_BITS).cast("int")
    slots = patterns.select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy()  # at most 2 ** BITMAP_BITS
    bits = np.zeros(1 << BITMAP_BITS, bool)
    bits[slots] = True
    shared = scratch.broadcast(np.packbits(bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            hits = [np.zeros(0, tb.U64)]
            for _, _, data, bounds in tb.chunks(batch.column(0)):
                single, double = _context_hashes(*tb.words(_FOLD[data], bounds))
                for h in (single ^ _SALTS[0], double ^ _SALTS[1], single ^ _SALTS[2], double ^ _SALTS[3]):
                    hits.append(h[wanted[(h >> tb.U64(64 - BITMAP_BITS)).astype(np.int64)]])
            context, n = np.unique(np.concatenate(hits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(n)], names=["context", "total"])

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tb.tidy(count), "context long, total long")
    return counts.groupBy("context").agg(F.sum("total").alias("total")).join(patterns.select("context").distinct(), "context", "left_semi")


def confident_patterns(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """(context, kind, confidence) of the patterns that the last round trusts, and of the seeds' values that also stand unproved."""
    found = scratch.settle(edges(docs, text))
    # an unproved number can be of any kind but an address, a spelt-out address only that
    fits = F.when(F.col("kind") == "email", F.array(F.lit("email"))).otherwise(F.array(*(F.lit(k) for k in KINDS[1:])))
    values = found.where("seed").groupBy("value", "kind").agg(F.bool_or("alone").alias("alone"))
    open_edges = found.where("not seed").select("context", "value", "n", F.explode(fits).alias("kind"))
    known = values.join(open_edges.select("value", "kind").distinct().withColumn("open", F.lit(True)), ["value", "kind"], "left").where(F.col("alone") | F.col("open"))
    known = scratch.settle(known.select("value", "kind"))
    told = found.where("seed").select("context", "value", "kind", "n").unionByName(open_edges.join(known, ["value", "kind"]))
    seeds = scratch.settle(told.groupBy("context", "value", "kind").agg(F.sum("n").alias("n")).withColumn("trust", F.lit(1.0)))
    open_edges = scratch.settle(open_edges.join(known, ["value", "kind"], "left_anti"))
    trusted, totals, before = seeds, None, None
    while True:
        scored = trusted.groupBy("context", "kind").agg(F.sum("trust").alias("hits"), F.sum(F.col("trust") * F.col("n")).alias("places")).where(F.col("hits") >= MIN_INSTANCES - 1e-9)
        scored = scratch.settle(scored)
        new = scored.select("context").distinct() if totals is None else scored.select("context").distinct().join(totals, "context", "left_anti")
        more = totals is None or not new.isEmpty()
        if more:
            counted = scratch.settle(occurrences(docs, new, scratch, text))
            totals = counted if totals is None else totals.unionByName(counted)
        confidence = (F.col("places") / F.greatest("total", "places")).alias("confidence")
        patterns = scratch.settle(scored.join(totals, "context").select("context", "kind", confidence).where(F.col("confidence") >= MIN_CONFIDENCE))
        if not more and before is not None:
            both = patterns.join(before.withColumnRenamed("confidence", "was"), ["context", "kind"], "full")
            if (both.agg(F.max(F.abs(F.coalesce("confidence", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0) < SETTLED:
                break
        before = patterns
        miss = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence"))))
        trust = open_edges.join(patterns, ["context", "kind"]).groupBy("value", "kind").agg((1 - F.exp(miss)).alias("trust"))
        trusted = seeds.unionByName(open_edges.join(trust, ["value", "kind"]).select("context", "value", "kind", "n", "trust"))
    own = known.select(F.col("value").bitwiseXOR(F.lit(_VALUE_SALT)).alias("context"), "kind", F.lit(1.0).alias("confidence"))
    return scratch.settle(patterns.unionByName(own))


_FOUND = "array<struct<kind:string,start:int,stop:int,confidence:double,contexts:array<long>>>"
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("confidence", pa.float64()), ("contexts", pa.list_(pa.int64()))]))


class Patterns:
    """Confident patterns, sorted by context, for lookup."""

    def __init__(self, context: np.ndarray, kind: np.ndarray, confidence: np.ndarray):
        by = np.lexsort((kind, context))
        self.context, self.kind, self.confidence = context[by], kind[by].astype(np.int8), confidence[by].astype(np.float32)

    def best(self, own: list[int], email: bool) -> tuple[float, int]:
        """Confidence and kind of the best pattern among the contexts; 0 if none fits the shape."""
        out = 0.0, -1
        for context in own:
            a, b = np.searchsorted(self.context, [context, context + 1 if context < 2**63 - 1 else context], "left")
            for k in range(a, b):
                if (self.kind[k] == 0) == email:
                    out = max(out, (float(self.confidence[k]), -int(self.kind[k])), key=lambda x: (x[0], x[1] if x[0] else -9))
        return (out[0], -out[1]) if out[0] else (0.0, -1)


def _cut(text: str, found: list[dict]) -> str:
    """The text with each span as its kind in angle brackets; of spans that overlap, the one that starts first."""
    parts, at = [], 0
    for x in sorted((x for x in found if x["confidence"] > 0), key=lambda x: (x["start"], x["stop"])):
        if x["start"] >= at:
            parts += [text[at : x["start"]], f"<{x['kind'].upper()}>"]
        at = max(at, x["stop"])
    return "".join([*parts, text[at:]])


def judged(docs: DataFrame, patterns: DataFrame, text: str = "text", name: str = "__found", cut: bool = False) -> DataFrame:
    """docs and a column name: fixed spans (confidence 2) and unproved ones with the kind and confidence of their best pattern (0: none). With cut, texts are replaced by what _cut leaves of them, and of the spans one at most is told."""
    from pyspark.sql.types import StructField, StructType

    blocks = max(1, -(-patterns.count() // MOST_PATTERNS))
    at = docs.columns.index(text)
    kind = docs.sparkSession.createDataFrame([], f"s {_FOUND}").schema["s"].dataType
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1
    out = docs
    for number in range(blocks):
        part = patterns.where(F.pmod(F.xxhash64("context"), F.lit(blocks)) == number).select("context", rank.alias("kind"), "confidence").toArrow()  # about MOST_PATTERNS rows
        shared = docs.sparkSession.sparkContext.broadcast(Patterns(*(part.column(c).to_numpy() for c in ("context", "kind", "confidence"))))

        def rows(batches: Iterator[pa.RecordBatch], shared=shared, first=number == 0, last=number == blocks - 1) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, texts = [], []
                for i, one in enumerate(batch.column(at)):
                    body = one.as_py()
                    if first:
                        own = [{"kind": k, "start": a, "stop": b, "confidence": 2.0 * seed, "contexts": None if seed else [*contexts(body, a, b), _value(body[a:b]) ^ _VALUE_SALT]} for k, a, b, seed in spans(body or "")]
                    else:
                        own = batch.column(batch.num_columns - 1)[i].as_py()
                    for x in own:
                        if x["confidence"] < 2:
                            confidence, k = shared.value.best(x["contexts"], x["kind"] == "email")
                            if confidence > x["confidence"] or confidence and confidence == x["confidence"] and k < KINDS.index(x["kind"]):
                                x["confidence"], x["kind"] = confidence, KINDS[k]
                    if cut and last:
                        texts.append(None if body is None else _cut(body, own))
                        own = [x for x in own if x["confidence"] > 0][:1]
                    found.append(own)
                kept = [*(batch.columns if first else batch.columns[:-1])]
                if cut and last:
                    kept[at] = pa.array(texts, pa.string())
                names = batch.schema.names if first else batch.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, _FOUND_ARROW)], names=[*names, name])

        out = out.mapInArrow(tb.tidy(rows), StructType([*docs.schema.fields, StructField(name, kind)]))
    return out


def _joined(spans) -> object:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the counts and the digest are of the fixed patterns."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        found = judged(narrow, confident_patterns(narrow, scratch))
    fixed = F.filter("__found", lambda s: s["confidence"] == 2)
    order = F.array(*(F.lit(k) for k in KINDS))
    every = F.array_sort(F.transform(F.filter("__found", lambda s: s["confidence"] > 0), lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    counts = [F.size(F.filter(F.transform(fixed, lambda s: s["kind"]), F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(fixed), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in angle brackets, and ``n_chars`` set anew where there is one; null texts stay null. No text leaves its task."""
    plain, name = docs.withColumn(text, F.col(text).cast("string")), fresh("__found", docs.columns)
    with Scratch(docs.sparkSession) as scratch:
        out = judged(plain, confident_patterns(plain.select(F.col(text).alias("text")), scratch), text, name, True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return detect(table(spark, sf_dir, "documents"))
