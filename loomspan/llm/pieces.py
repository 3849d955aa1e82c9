"""SentencePiece encoding and decoding by vectorised merge rounds.

A text's spaces are word marks, and one mark goes before it. No piece of the vocabulary
holds a mark after another character, so a text's ids are those of its words (marks and
what follows them) one after the other; a worker remembers the words it has met. New
words are laid out as flat arrays of symbols and cut where no piece holds the two
characters beside each other. Every round finds the least pair rank of each word,
merges its occurrences from the left at once, and drops what was merged away, until no
pair is left. A merge that makes a pair of no greater rank than its own ends its word's
round, as that pair would come next: so the order is that of one merge at a time.

``encode`` and ``decode`` are the library's for BPE models with byte fallback, without
normalisation and with the mark before the text; other models are an error.

Defined results: null texts are empty; an empty text has the begin and end ids alone and
decodes to the empty text. Ids outside the vocabulary are an error. Repeated rows are
encoded each, an empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words and their ids that a worker remembers, and their letters and ids together: some 60 MB.
MOST_WORDS, MOST_HELD = 1 << 18, 1 << 23
#: Bytes of a text that are encoded at once, but for longer words.
STRETCH = 1 << 21
#: Symbols from which on a word has rounds of its own, each of which touches only what it merges.
LONG = 512
NONE = np.int32(2**31 - 1)

codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Vocabulary:
    """A model's pieces, the pairs that make them, and the words met so far."""

    def __init__(self, path: str):
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model = ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        how, rule = model.trainer_spec, model.normalizer_spec
        kind = np.array([p.type for p in model.pieces])
        named = ModelProto.SentencePiece
        plain = how.model_type == how.BPE and how.byte_fallback and not how.treat_whitespace_as_suffix and not rule.precompiled_charsmap
        plain = plain and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
        if not plain or np.isin(kind, (named.USER_DEFINED, named.UNUSED)).any():
            raise ValueError("a kind of model that isn't read")
        pieces = [p.piece for p in model.pieces]
        ids = {s: i for i, s in enumerate(pieces) if kind[i] == named.NORMAL}
        if any(MARK in s.lstrip(MARK) for s in ids):
            raise ValueError("pieces that hold a word mark inside aren't read")
        self.size = len(pieces)
        self.bos, self.eos = how.bos_id, how.eos_id
        self.byte = np.zeros(256, np.int32)
        for i in np.flatnonzero(kind == named.BYTE):
            self.byte[int(pieces[i][1:-1], 16)] = i
        # equal scores are equal ranks
        rank = np.unique([-p.score for p in model.pieces], return_inverse=True)[1]
        pairs = sorted((ids[s[:k]] * self.size + ids[s[k:]], rank[i], i) for s, i in ids.items() for k in range(1, len(s)) if s[:k] in ids and s[k:] in ids)
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.rank = np.array([p[1] for p in pairs], np.int32)
        self.made = np.array([p[2] for p in pairs], np.int32)
        self.char = np.full(0x110000, self.size, np.int32)
        for s, i in ids.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.char[32] = self.char[ord(MARK)]
        self.beside = np.unique([ord(a) << 32 | ord(b) for s in ids for a, b in zip(s, s[1:], strict=False)])
        marks = {len(s): rank[i] for s, i in ids.items() if len(s) > 1 and not s.strip(MARK)}
        most = max(marks, default=0)
        #: The longest piece of marks alone, if such pieces are made last and from the left: longer runs are cut there.
        self.run = 0
        if marks and len(set(marks.values())) == 1 and all(rank[i] < marks[most] for s, i in ids.items() if len(s) > 1 and s.strip(MARK)):
            alone = self._rounds(np.full(4 * most, self.char[32]), np.zeros(1, np.int64))[1]
            self.run = most if alone.tolist() == [0, most, 2 * most, 3 * most] else 0
        text = [b"" if kind[i] == named.CONTROL else " ⁇ ".encode() if kind[i] == named.UNKNOWN else bytes([int(s[1:-1], 16)]) if kind[i] == named.BYTE else s.replace(MARK, " ").encode() for i, s in enumerate(pieces)]
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.silent = kind == named.CONTROL
        self.marked = np.array([kind[i] == named.NORMAL and s.startswith(MARK) for i, s in enumerate(pieces)])
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.flat, self.at = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE where it is no piece) and the piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left < self.size) & (right < self.size)
        return np.where(found, self.rank[at], NONE), self.made[at]

    def _rounds(self, sym: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words (that begin at begin) when no pair is left, and the place of each one's first character."""
        n = len(sym)
        size = np.diff(np.append(begin, n))
        out = [self._long(sym[a : a + m], a) for a, m in zip(begin[size > LONG].tolist(), size[size > LONG].tolist(), strict=True)]
        short = np.repeat(size <= LONG, size)
        sym, start, seg = sym[short], np.flatnonzero(short), np.repeat(np.arange(len(size)), size)[short]
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int32)
        if len(sym):
            rank[:-1], made[:-1] = self._pairs(sym[:-1], sym[1:])
            rank[np.append(seg[1:] != seg[:-1], True)] = NONE
        while len(sym):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            go = least < NONE
            if not go.all():
                out.append((sym[~go], start[~go]))
                sym, start, seg, rank, made, least = sym[go], start[go], seg[go], rank[go], made[go], least[go]
                if not len(sym):
                    break
            take = _leftmost(np.flatnonzero(rank == least))
            # a new pair of no greater rank comes before the word's later occurrences
            whole = made[take]
            left, same = take - 1, np.append(False, take[1:] == take[:-1] + 2) & np.append(False, seg[take[1:]] == seg[take[:-1]])
            before = np.where(same, np.append(self.size, whole[:-1]), sym[left])
            low = np.where((take > 0) & (seg[left] == seg[take]), self._pairs(before, whole)[0], NONE) <= least[take]
            after = np.minimum(take + 2, len(sym) - 1)
            low |= np.where((take + 2 < len(sym)) & (seg[after] == seg[take]), self._pairs(whole, sym[after])[0], NONE) <= least[take]
            if low.any():
                ends = np.full(int(seg[-1]) + 1, len(sym))
                np.minimum.at(ends, seg[take[low]], take[low])
                take = take[take <= ends[seg[take]]]
                whole = made[take]
            sym[take] = whole
            stay = np.ones(len(sym), bool)
            stay[take + 1] = False
            place = take - np.arange(len(take))
            sym, start, seg, rank, made = sym[stay], start[stay], seg[stay], rank[stay], made[stay]
            touched = np.zeros(len(sym), bool)
            touched[place] = touched[np.maximum(place - 1, 0)] = True
            rank[touched] = NONE
            touched &= np.append(seg[1:] == seg[:-1], False)
            renew = np.flatnonzero(touched)
            rank[renew], made[renew] = self._pairs(sym[renew], sym[renew + 1])
        both = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int32), np.zeros(0, np.int64)]
        order = np.argsort(both[1])
        return both[0][order], both[1][order]

    def _long(self, sym: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """The rounds of one long word: places wait by rank, so that a round costs what it merges and not the word's length."""
        n = len(sym)
        sym, after, before = sym.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, made = np.full(n, NONE), np.zeros(n, np.int32)
        rank[:-1], made[:-1] = self._pairs(sym[:-1], sym[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []
        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            at = np.flatnonzero(np.append(True, np.diff(rank[places]) > 0)) if len(places) else []
            for part in np.split(places, at[1:]) if len(places) else []:
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(part)

        wait(np.arange(n))
        live = np.ones(n, bool)
        while queue:
            r = heapq.heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[live[places] & (rank[places] == r)]
            # of places that overlap, each second one goes
            chain = np.append(False, after[places[:-1]] == places[1:]) if len(places) else np.zeros(0, bool)
            index = np.arange(len(places))
            take = places[(index - np.maximum.accumulate(np.where(chain, 0, index))) % 2 == 0]
            if not len(take):
                continue
            whole, right, left = made[take], after[take], before[take]
            beyond = after[right]
            joined = np.append(False, right[:-1] == left[1:])
            prior = np.where(joined, np.append(self.size, whole[:-1]), sym[left])
            low = np.where(left >= 0, self._pairs(prior, whole)[0], NONE) <= r
            low |= np.where(beyond < n, self._pairs(whole, sym[np.minimum(beyond, n - 1)])[0], NONE) <= r
            if low.any():
                k = int(np.argmax(low)) + 1
                wait(places[places > take[k - 1]])
                take, whole, right, beyond = take[:k], whole[:k], right[:k], beyond[:k]
            sym[take] = whole
            live[right] = False
            rank[right] = NONE
            after[take] = beyond
            inner = beyond < n
            before[beyond[inner]] = take[inner]
            renew = np.unique(np.concatenate([take, before[take]]))
            renew = renew[renew >= 0]
            rank[renew] = NONE
            open_ = renew[after[renew] < n]
            rank[open_], made[open_] = self._pairs(sym[open_], sym[after[open_]])
            wait(open_)
        return sym[live], np.flatnonzero(live) + base

    def _learn(self, words: list[bytes]) -> None:
        """Put new words (of a mark and more, as spaces and letters) and their ids into the store."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        head = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where characters begin
        code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        code[code == 32] = ord(MARK)
        size = np.array([len(w) for w in words])
        opens = np.searchsorted(head, np.cumsum(size) - size)
        cut = np.zeros(len(code), bool)
        pair = code[:-1] << 32 | code[1:]
        cut[1:] = self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] != pair
        cut[opens] = True
        if self.run:
            mark = code == ord(MARK)
            place = np.arange(len(code)) - np.repeat(opens, np.diff(np.append(opens, len(code))))
            cut[1:] |= mark[:-1] & mark[1:] & (place[1:] % self.run == 0)
        sym, start = self._rounds(self.char[code], np.flatnonzero(cut))
        strange = sym == self.size
        many = np.where(strange, np.diff(head)[start], 1)
        ids = np.repeat(sym, many)
        spot = np.repeat(strange, many)
        inside = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
        ids[spot] = self.byte[raw[np.repeat(head[start], many)[spot] + inside[spot]]]
        count = np.add.reduceat(many, np.searchsorted(start, opens))
        w, f = len(self.known), int(self.at[len(self.known)])
        while f + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while w + len(words) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[f : f + len(ids)] = ids
        self.at[w + 1 : w + len(words) + 1] = f + np.cumsum(count)
        self.known.update(zip(words, range(w, w + len(words)), strict=True))
        self.held += len(raw) + 4 * len(ids)

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose bytes begin with a mark (as a space), and the n + 1 places where each text's begin."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        if len(self.known) > MOST_WORDS or self.held > MOST_HELD:
            self.forget()
        opens = data == 32
        opens[1:] &= data[:-1] != 32
        opens[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        at = np.append(np.flatnonzero(opens), len(data))
        offsets = pa.py_buffer(at.astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        word = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        start, many = self.at[word], self.at[word + 1] - self.at[word]
        ends = np.cumsum(many)
        flat = self.flat[np.arange(int(ends[-1])) + np.repeat(start - ends + many, many)]
        return flat, np.append(0, ends)[np.searchsorted(at, bounds)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 are replacement characters, each one. Begin and end ids part the bytes beside them."""
        out = []
        for part in np.split(ids, np.flatnonzero(self.silent[ids])):
            part = part[~self.silent[part]]
            if len(part):
                size = self.text_at[part + 1] - self.text_at[part]
                ends = np.cumsum(size)
                raw = self.text[np.arange(int(ends[-1])) + np.repeat(self.text_at[part] - ends + size, size)].tobytes()
                out.append(raw[0 if out else int(self.marked[part[0]]) :].decode("utf-8", "each_byte"))
        return "".join(out)


def _leftmost(at: np.ndarray) -> np.ndarray:
    """Of places in ascending order, those that are left when each one taken rules out the place after it."""
    index = np.arange(len(at))
    run = np.append(True, at[1:] != at[:-1] + 1)
    return at[(index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's own, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _stretches(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that begin with words."""
    while len(data) > STRETCH:
        opens = np.flatnonzero((data[1 : STRETCH + 1] == 32) & (data[:STRETCH] != 32))
        if len(opens):
            cut = int(opens[-1]) + 1
        else:
            after = np.flatnonzero((data[STRETCH + 1 :] == 32) & (data[STRETCH:-1] != 32))
            cut = STRETCH + 1 + int(after[0]) if len(after) else len(data)
        yield data[:cut]
        data = data[cut:]
    if len(data):
        yield data


def _marked(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a mark before each that isn't empty; written marks count as spaces."""
    mark = MARK.encode()
    if mark in (raw := data.tobytes()):
        parts = [raw[a:b].replace(mark, b" ") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        data, bounds = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    some = bounds[:-1] < bounds[1:]
    return np.insert(data, bounds[:-1][some], 32), bounds + np.append(0, np.cumsum(some))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, begin: bool = True, end: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids): every text's ids as little-endian unsigned 32-bit numbers, with the begin and end ids if wanted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model or default_model())
        head = np.array([words.bos] if begin else [], "<u4").tobytes()
        tail = np.array([words.eos] if end else [], "<u4").tobytes()
        for batch in batches:
            for first, last, data, bounds in tb.chunks(batch.column(1)):
                data, bounds = _marked(data, bounds)
                if len(data) > STRETCH:
                    found = [b"".join(words.ids(part, np.array([0, len(part)]))[0].astype("<u4").tobytes() for part in _stretches(data))] if len(bounds) == 2 else None
                else:
                    found = None
                if found is None:
                    flat, at = words.ids(data, bounds)
                    raw = flat.astype("<u4").tobytes()
                    found = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                found = [head + x + tail for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return ids.mapInArrow(tb.tidy(rows), "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of ids as encode writes them; null ids are none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model or default_model())
        for batch in batches:
            first, size, found = 0, 0, []
            for k, one in enumerate(batch.column(1)):
                numbers = np.frombuffer(one.as_py() or b"", "<u4").astype(np.int64)
                found.append(words.decode(numbers))
                size += 4 * len(numbers)
                if size > 4 * tb.CHUNK_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), batch.column(1).slice(first, len(found)), pa.array(found, pa.string())], names=["doc_id", "ids", "text"])
                    first, size, found = k + 1, 0, []

    kept = tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    return kept.mapInArrow(tb.tidy(rows), "doc_id long, ids binary, text string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number and digest of its ids, digest of the text they stand for."""
    back = decode(encode(table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
