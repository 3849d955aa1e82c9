"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of about PASSAGE words; a distributed randomised
SVD of their TF-IDF vectors gives a latent basis (document frequencies come from all
documents, without the stretches that share LEAST words in a row with an item, so that
leaks don't make their own words common; no word weighs nothing). Every window of every
document (two lengths, half overlapping) is a TF-IDF vector, projected onto the basis
and compared with all passages by cosine. A candidate is checked on the words themselves: the longest common subsequence of passage and
surroundings of the window, and how many of the passage's rarest words - its answer -
stand there. It is a match with half of the passage in order and most of the answer:
the passage itself or a paraphrase.

Windows whose words together can't reach the cosine with any passage are not projected
(each word's most is known), and candidates without enough words of answers around them
are not aligned; neither loses a match. Copies don't depend on the cosine: every LEAST words in a row of a passage
are looked up in the documents, and a place that has them is a candidate too.

The benchmark is the stated query set: it is read in blocks of about BLOCK passages, so
what is broadcast has a bounded size, and every block is searched in all documents. A
block's basis has a dimension for each of its passages, so a passage's vector keeps its
length however many blocks there are.

Defined results: null and empty texts match nothing; items of fewer than LEAST words
match nothing, as they can't be told from chance. A document that holds an item more
than once has one row for it; repeated rows of a document each have their own. Further
columns are ignored by ``matches`` and kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import settle, table

DF_BITS = 16
BITS = 18
STEP = 16
#: Window lengths in steps.
SCALES = (2, 4)
PASSAGE = 64
LEAST = 5
BLOCK = 256
COSINE = 0.3
HALF, ANSWER = 0.5, 0.6
#: Bits of the map of the items' stretches of LEAST words.
MARK_BITS = 23


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of letters or digits, capitals folded."""
    kind = tb.KIND[data]
    starts, ends, row = tb.runs(((kind == 1) | (kind == 2)).astype(np.uint8), bounds)
    return (tb.Prefix(tb.fold(data)).of(starts, ends) if len(starts) else np.zeros(0, tb.U64)), row


def stretches(h: np.ndarray) -> np.ndarray:
    """Hash of each LEAST words in a row."""
    n = max(0, len(h) - LEAST + 1)
    acc = np.zeros(n, tb.U64)
    for j in range(LEAST):
        acc = (acc + h[j : j + n]) * tb.U64(0x9E3779B97F4A7C15)
    return tb.mix(acc)


def marks(units: DataFrame) -> np.ndarray:
    """Map of the stretches of all passages, as packed bits."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [stretches(words.values.to_numpy().view(tb.U64)) >> tb.U64(64 - MARK_BITS) for words in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, tb.U64), *own])).astype(np.int32))], names=["slot"])

    bits = np.zeros(1 << MARK_BITS, bool)
    bits[units.select("words").mapInArrow(tb.tidy(slots), "slot int").distinct().toPandas()["slot"].to_numpy(np.int64)] = True  # at most 2 ** MARK_BITS
    return np.packbits(bits)


def inverse_frequency(docs: DataFrame, text: str = "text", marked: np.ndarray | None = None) -> np.ndarray:
    """log(1 + documents / documents with the bucket), float32, by bucket of word hashes; over all texts, without the stretches that are marked."""
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + (1 << DF_BITS), np.int64)
        bits = None if shared.value is None else np.unpackbits(shared.value).view(bool)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, _, data, bounds in tb.chunks(batch.column(0)):
                h, row = tokens(data, bounds)
                if bits is not None and len(h) >= LEAST:
                    hit = np.flatnonzero(bits[(stretches(h) >> tb.U64(64 - MARK_BITS)).astype(np.int64)] & (row[: 1 - LEAST] == row[LEAST - 1 :]))
                    clear = np.ones(len(h), bool)
                    for j in range(LEAST):
                        clear[hit + j] = False
                    h, row = h[clear], row[clear]
                own = np.unique(row << DF_BITS | (h >> tb.U64(64 - DF_BITS)).astype(np.int64)) & ((1 << DF_BITS) - 1)
                total[:-1] += np.bincount(own, minlength=1 << DF_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    sums = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tb.tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    shared.unpersist()
    total = np.zeros(1 + (1 << DF_BITS))
    total[sums["bucket"].to_numpy(np.int64)] = sums["n"]
    return np.log1p(max(1, total[-1]) / np.maximum(1, total[:-1])).astype(np.float32)


def passages(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words): hashes of each passage of LEAST words or more; the last of an item is up to twice as long."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = [], []
            for first, end, data, bounds in tb.chunks(batch.column(1)):
                h, row = tokens(data, bounds)
                at = tb.row_starts(row, end - first)
                for i in range(end - first):
                    own = h[at[i] : at[i + 1]]
                    if len(own) >= LEAST:
                        parts = max(1, len(own) // PASSAGE)
                        for k in range(parts):
                            ids.append(batch.column(0)[first + i].as_py())
                            words.append(own[k * PASSAGE : (k + 1) * PASSAGE if k < parts - 1 else None].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])

    narrow = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(tb.tidy(cut), "item_id long, words array<long>")


def _vector(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length (or zero) TF-IDF weights of a passage."""
    bucket, n = np.unique((words.view(tb.U64) >> tb.U64(64 - BITS)).astype(np.int64), return_counts=True)
    weight = n * idf[bucket >> (BITS - DF_BITS)]
    return bucket, weight / max(1e-9, float(np.linalg.norm(weight)))


def randomised_svd(units: DataFrame, idf: np.ndarray, rank: int, oversample: int = 8, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the passages' words (sorted), and the leading right singular vectors of their TF-IDF matrix A, a row for each bucket.

    Tasks make A's rows and add up A'(A Omega), then the small (A Q)'(A Q); neither A
    nor its products by row leave the tasks.
    """
    spark = units.sparkSession
    shared = spark.sparkContext.broadcast(idf)
    width = rank + oversample
    columns = [f"z{j}" for j in range(width)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for words in batch.column(0):
                bucket, weight = _vector(words.values.to_numpy(), shared.value)
                omega = np.stack([np.random.default_rng((seed, int(b))).standard_normal(width) for b in bucket])
                y = weight @ omega
                for b, x in zip(bucket.tolist(), weight, strict=True):
                    held[b] = held.get(b, 0) + x * y
        if held:
            rows = np.stack(list(held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *(pa.array(rows[:, j]) for j in range(width))], names=["bucket", *columns])

    schema = ", ".join(["bucket long", *(f"{c} double" for c in columns)])
    z = units.select("words").mapInArrow(tb.tidy(project), schema).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toPandas().sort_values("bucket")
    vocabulary = z["bucket"].to_numpy(np.int64)
    if not len(vocabulary):
        return vocabulary, np.zeros((0, 1), np.float32)
    q, _ = np.linalg.qr(z[columns].to_numpy())
    basis = spark.sparkContext.broadcast((vocabulary, q))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = basis.value
        total = np.zeros((m.shape[1], m.shape[1]))
        for batch in batches:
            for words in batch.column(0):
                bucket, weight = _vector(words.values.to_numpy(), shared.value)
                b = weight @ m[np.searchsorted(own, bucket)]
                total += np.outer(b, b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[0]).astype(np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = units.select("words").mapInArrow(tb.tidy(gram), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    for one in (shared, basis):
        one.unpersist()
    small = np.zeros((q.shape[1], q.shape[1]))
    small[parts["i"], parts["j"]] = parts["x"]
    values, vectors = np.linalg.eigh(small)
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9 * max(1e-30, values.max())]
    return vocabulary, (q @ vectors[:, keep]).astype(np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Index:
    """Basis, passages and their latent unit vectors of one block."""

    def __init__(self, idf: np.ndarray, vocabulary: np.ndarray, basis: np.ndarray, items: list[int], words: list[np.ndarray]):
        self.idf, self.items, self.words = idf, items, words
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[vocabulary] = np.arange(len(vocabulary))
        self.basis = np.vstack([basis, np.zeros((1, basis.shape[1]), np.float32)])  # the last row is that of all other words
        latent = []
        self.answers = []
        for w in words:
            bucket, weight = _vector(w, idf)
            latent.append(weight @ self.basis[self.place[bucket]])
            rare = np.argsort(-idf[(w.view(tb.U64) >> tb.U64(64 - DF_BITS)).astype(np.int64)], kind="stable")
            self.answers.append(set(w[rare[: max(3, len(w) // 4)]].tolist()))
        # every stretch of LEAST words, with its passage and its place there
        grams = [stretches(w.view(tb.U64)) for w in words]
        unit, place = np.repeat(np.arange(len(words)), [len(g) for g in grams]), np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        grams = np.concatenate([np.zeros(0, tb.U64), *grams])
        order = np.argsort(grams, kind="stable")
        self.grams, self.gram_unit, self.gram_place = grams[order], unit[order], place[order]
        self.marked = np.zeros(1 << BITS, bool)
        self.marked[(grams >> tb.U64(64 - BITS)).astype(np.int64)] = True
        latent = np.stack(latent) if latent else np.zeros((0, basis.shape[1]))
        self.latent = (latent / np.maximum(1e-9, np.linalg.norm(latent, axis=1, keepdims=True))).astype(np.float32).T
        # the most that one occurrence of a word adds to the product with any passage
        most = (self.basis @ self.latent).max(axis=1, initial=0.0)
        self.most = np.zeros(1 << BITS, np.float32)
        self.most[vocabulary] = most[: len(vocabulary)] * idf[vocabulary >> (BITS - DF_BITS)]
        # how many of its answer words a passage needs, and a map of the answer words of all
        self.need = np.array([-(-len(a) * int(100 * ANSWER) // 100) for a in self.answers], np.int64)
        self.rare = np.zeros(1 << BITS, bool)
        self.rare[(np.array([x for a in self.answers for x in a], np.int64).view(tb.U64) >> tb.U64(64 - BITS)).astype(np.int64)] = True
        self.length = np.array([len(w) for w in words], np.int64)

    def search(self, data: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item): cosine, share of the passage in order, share of the answer, of each match."""
        h, row = tokens(data, bounds)
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(h) or not self.items:
            return found
        at = tb.row_starts(row, len(bounds) - 1)
        self._by_cosine(h, at, found)
        self._by_stretches(h, row, at, found)
        return found

    def _by_stretches(self, h, row, at, found) -> None:
        """Checks where LEAST words in a row of a passage stand; each place once for a passage."""
        grams = stretches(h)
        some = np.flatnonzero(self.marked[(grams >> tb.U64(64 - BITS)).astype(np.int64)])
        some = some[row[some] == row[some + LEAST - 1]]
        low, high = np.searchsorted(self.grams, grams[some], "left"), np.searchsorted(self.grams, grams[some], "right")
        done: dict[tuple[int, int], int] = {}
        for i in np.flatnonzero(high > low):
            start, t = int(some[i]), int(row[some[i]])
            for k in range(low[i], high[i]):
                unit = int(self.gram_unit[k])
                begin = start - int(self.gram_place[k])
                if done.get((t, unit)) == begin:
                    continue
                done[t, unit] = begin
                passage = self.words[unit]
                a, b = max(at[t], begin), min(at[t + 1], begin + len(passage))
                key = t, self.items[unit]
                before = found.get(key)
                self._check(h, a, b, at[t], at[t + 1], key, unit, 0.0, found)
                if found.get(key) != before:
                    found[key] = self._cosine(passage, h[a:b].view(np.int64)), *found[key][1:]

    def _cosine(self, a: np.ndarray, b: np.ndarray) -> float:
        (x, v), (y, w) = _vector(a, self.idf), _vector(b, self.idf)
        _, i, j = np.intersect1d(x, y, True, True)
        return float(v[i] @ w[j])

    def _by_cosine(self, h, at, found) -> None:
        # blocks of STEP words that start anew in each text; windows are two or four blocks
        blocks = -(-np.diff(at) // STEP)
        text = np.repeat(np.arange(len(blocks)), blocks)
        start = at[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * STEP
        idf = self.idf[(h >> tb.U64(64 - DF_BITS)).astype(np.int64)]
        place = self.place[(h >> tb.U64(64 - BITS)).astype(np.int64)]
        counts = np.flatnonzero((place >= 0) & (idf > 0))
        energy = np.add.reduceat(idf * idf, start)
        bucket = (h >> tb.U64(64 - BITS)).astype(np.int64)
        own = np.add.reduceat(self.most[bucket], start)
        rare = np.concatenate([[0], np.cumsum(self.rare[bucket])])
        sums, owns = np.concatenate([[0], np.cumsum(energy, dtype=np.float64)]), np.concatenate([[0], np.cumsum(own, dtype=np.float64)])
        end_of_text, first = np.searchsorted(text, text, "right"), np.arange(len(text))
        windows = []
        for scale in SCALES:
            last = np.minimum(first + scale, end_of_text)
            total = sums[last] - sums[first]
            worth = (owns[last] - owns[first] >= (COSINE - 1e-4) * np.sqrt(total)) & (total > 0)
            windows.append(np.stack([first[worth], last[worth]], axis=1))
        windows = np.unique(np.concatenate(windows), axis=0)
        if not len(windows):
            return
        # latent sums of the blocks that some window needs
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, windows[:, 0], 1)
        np.add.at(cover, windows[:, 1], -1)
        needed = np.cumsum(cover[:-1]) > 0
        of = np.searchsorted(start, counts, "right") - 1
        counts, of = counts[needed[of]], of[needed[of]]
        latent = np.zeros((len(text) + 1, self.basis.shape[1]), np.float32)  # one more block, of nothing
        for i in range(0, len(counts), 1 << 15):
            k = slice(i, i + (1 << 15))
            rows = self.basis[place[counts[k]]]
            rows *= idf[counts[k], None]
            block, begins = np.unique(of[k], return_index=True)
            latent[block] += np.add.reduceat(rows, begins, axis=0)
        for i in range(0, len(windows), 4096):
            a, b = windows[i : i + 4096].T
            z = latent[a]
            for step in range(1, max(SCALES)):
                z += latent[np.where(a + step < b, a + step, len(text))]
            norm = np.sqrt(sums[b] - sums[a])  # a repeated word counts once for each time: never too long
            cosine = z @ self.latent
            cosine /= norm[:, None].astype(np.float32)
            near, units = np.nonzero(cosine >= COSINE)
            begin, t = start[a[near]], text[a[near]]
            end = np.minimum(at[t + 1], np.append(start, len(h))[b[near]])
            # without enough answer words of any passage around it there is nothing to check
            able = rare[np.minimum(at[t + 1], end + self.length[units])] - rare[np.maximum(at[t], begin - self.length[units])] >= self.need[units]
            for w, unit, x, y, row in zip(near[able], units[able], begin[able], end[able], t[able].tolist(), strict=True):
                self._check(h, x, y, at[row], at[row + 1], (row, self.items[unit]), unit, float(cosine[w, unit]), found)

    def _check(self, h, start, end, low, high, key, unit, cosine, found) -> None:
        passage = self.words[unit]
        if found.get(key, (0, 0.0, 0))[1] >= 1.0:
            return
        around = h[max(low, start - len(passage)) : min(high, end + len(passage))].view(np.int64)
        answer = len(self.answers[unit].intersection(around.tolist())) / len(self.answers[unit])
        if answer < ANSWER:
            return
        share = lcs(passage, around) / len(passage)
        if share >= HALF and found.get(key, (0, 0.0, 0))[1] < share:
            found[key] = cosine, share, answer


def indexes(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", item_text: str = "text") -> tuple[int, Iterator[Index]]:
    """The number of blocks of passages, and an index for each."""
    units = passages(benchmark, item_id, item_text)
    blocks = max(1, -(-units.count() // BLOCK))

    def each() -> Iterator[Index]:
        idf = inverse_frequency(docs, text, marks(units))
        for k in range(blocks):
            part = units.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k) if blocks > 1 else units
            rows = part.toArrow()  # about BLOCK passages
            vocabulary, basis = randomised_svd(part, idf, max(1, rows.num_rows))
            order = np.argsort(rows.column("item_id").to_numpy(zero_copy_only=False), kind="stable")
            words = rows.column("words").to_pylist()
            items = rows.column("item_id").to_pylist()
            yield Index(idf, vocabulary, basis, [items[i] for i in order], [np.array(words[i], np.int64) for i in order])

    return blocks, each()


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, in_order, answer) of every match."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks, every = indexes(narrow, benchmark.where(F.col(item_id).isNotNull()), item_id, "text", item_text)
    rows = narrow.withColumn("row", F.monotonically_increasing_id())
    if blocks > 1:
        rows = settle(rows)  # a row has one number in all passes
    out = None
    for index in every:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: list[tuple] = []
                for first, _, data, bounds in tb.chunks(batch.column(1)):
                    for (row, item), scores in sorted(shared.value.search(data, bounds).items()):
                        found.append((batch.column(2)[first + row].as_py(), batch.column(0)[first + row].as_py(), item, *scores))
                columns = list(zip(*found, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "doc_id", "item_id", "cosine", "in_order", "answer"])

        part = rows.mapInArrow(tb.tidy(find), "row long, doc_id long, item_id long, cosine double, in_order double, answer double")
        out = part if out is None else out.unionByName(part)
    if blocks > 1:  # the passages of an item may be in several blocks
        best = F.max_by(F.struct("cosine", "in_order", "answer"), F.struct("in_order", "cosine"))
        out = out.groupBy("row", "doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")
    return out.select("doc_id", "item_id", "cosine", "in_order", "answer")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    at, source = docs.columns.index(text), docs
    _, every = indexes(docs, benchmark.where(F.col(item_id).isNotNull()), item_id, text, item_text)
    for index in every:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, _, data, bounds in tb.chunks(batch.column(at)):
                    for row, _ in shared.value.search(data, bounds):
                        keep[first + row] = False
                yield batch.filter(pa.array(keep))

        source = source.mapInArrow(tb.tidy(clean), docs.schema)
    return source


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
