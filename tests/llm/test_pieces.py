"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from loomspan.llm import pieces, registry
from loomspan.llm import textbatch as tb


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def own():
    return pieces.Vocabulary(pieces.default_model())


def ids_of(own, texts):
    out = []
    for _, _, data, bounds in tb.chunks(pa.array(texts)):
        flat, at = own.ids(*pieces._marked(data, bounds))
        out += [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def random_texts(n, seed):
    r = random.Random(seed)
    parts = ["a", "b", "e", "th", " ", "  ", "\n", "\t", "=", "-", "é", "😀", "中文", "的", "▁", "\0", "</s>", "0", "1", "\r\n", "ing", "Ω", "ß", " " * 17]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_random_texts(own, library):
    texts = random_texts(3000, 1)
    assert ids_of(own, texts) == library.encode(texts)


def test_runs_of_marks_signs_and_letters(own, library):
    texts = [" " * k + x + " " * j for k in range(0, 70, 3) for j in (0, 1, 5, 16, 17, 33) for x in ("", "a", "the", "\n")]
    texts += [c * k for c in ("=", "a", "ab", "-=", "aab") for k in range(0, 300, 7)]
    assert ids_of(own, texts) == library.encode(texts)


def test_long_words_have_rounds_of_their_own(own, library):
    r = random.Random(2)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz0123456789", "=-_#*", "ab") for n in (pieces.LONG, pieces.LONG + 1, 5000, 40_000)]
    assert ids_of(own, texts) == library.encode(texts)


def test_rounds_merge_as_one_merge_at_a_time(own):
    """The definition: the best pair, the leftmost of equals, one at a time."""
    pair = {int(k): (int(r), int(m)) for k, r, m in zip(own.keys, own.rank, own.made, strict=True)}
    r = random.Random(5)
    for _ in range(200):
        text = "".join(r.choice("aeinrst=-") for _ in range(r.randint(1, 25)))
        symbols = own.char[[ord(c) for c in text]].tolist()
        while pairs := [(*pair[a * own.size + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a * own.size + b in pair]:
            _, made, i = min(pairs, key=lambda p: (p[0], p[2]))
            symbols[i : i + 2] = [made]
        assert own._rounds(own.char[[ord(c) for c in text]], np.zeros(1, np.int64))[0].tolist() == symbols


def test_decoding_any_ids(own, library):
    r = random.Random(3)
    for _ in range(3000):
        ids = [r.choice([r.randint(0, 31999), r.randint(0, 260), 28705]) for _ in range(r.randint(0, 12))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_query_equals_the_library_on_all_documents(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.QUERIES["op12_sentencepiece"](spark, small).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_odd_rows_and_bounded_memory(spark, library, monkeypatch):
    long = "word " * 700_000 + " the  end"
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a▁b", None), (3, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(pieces.decode(pieces.encode(docs)).collect(), key=lambda r: (r["doc_id"] or 0))
    want = [library.encode(t, add_bos=True, add_eos=True) for t in ("a▁b", "", "", "", long)]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == want
    assert [r["text"] for r in got] == [library.decode(x) for x in want]
    assert pieces.encode(docs.where("doc_id > 5")).count() == 0
    monkeypatch.setattr(pieces, "MOST_WORDS", 50)
    own = pieces.Vocabulary(pieces.default_model())
    for k in range(20):
        texts = random_texts(30, k)
        assert ids_of(own, texts) == library.encode(texts)
        assert len(own.known) < 2000


def test_other_models_are_an_error(tmp_path):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    model = ModelProto()
    with open(pieces.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="isn't read"):
        pieces.Vocabulary(str(tmp_path / "m"))
