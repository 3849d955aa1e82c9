"""Annotations and video boxes against plain Python; odd rows."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from loomspan.operators import annotations, digests, ranks
from loomspan.sources import boxes


def level(r):
    """A level in one of its forms, as JSON text."""
    frame = lambda: r.choice([0, 3, 7, -1, 12, "4", 2.5, True, None])
    caption = lambda: r.choice(["pick", "语", "", "unknown", 5, None, "a b."])
    kind = r.randrange(8)
    if kind < 3:
        return json.dumps({f"{r.randint(0, 4)}{r.choice([' ', ',', ' , '])}{r.randint(5, 9)}" if r.random() < 0.9 else "oops": caption() for _ in range(r.randint(0, 4))})
    if kind < 6:
        return json.dumps([({"start_frame": frame() if r.random() < 0.2 else r.randint(0, 4), "end_frame": r.randint(5, 9)} | r.choice([{"caption": caption()}, {"caption_en": caption(), "caption": "x"}, {}])) if r.random() < 0.9 else 7 for _ in range(r.randint(0, 4))])
    return r.choice(["17", "null", None, '"x"', "{}", "[]"])


def plain_entries(text):
    value = None if text is None else json.loads(text)
    if value is None or value == {} or value == []:
        return [], False
    out, broken = [], False
    if isinstance(value, dict):
        for key, caption in value.items():
            parts = key.replace(",", " ").split()
            if len(parts) == 2 and all(p.lstrip("-").isdigit() for p in parts):
                out.append((int(parts[0]), int(parts[1]), caption if isinstance(caption, str) else ""))
            else:
                broken = True
    elif isinstance(value, list):
        for item in value:
            ok = isinstance(item, dict) and all(type(item.get(c)) is int for c in ("start_frame", "end_frame"))
            broken |= not ok
            if ok:
                caption = item.get("caption_en", item.get("caption", ""))
                out.append((item["start_frame"], item["end_frame"], caption if isinstance(caption, str) else ""))
    else:
        broken = True
    return out, broken


def valid(caption):
    return any(c.isascii() and c.isalpha() for c in caption) and "语" not in caption and caption != "unknown"


def test_random_levels_and_overlays(spark):
    r = random.Random(1)
    rows = [(i, level(r), level(r)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {x["id"]: ([tuple(e) for e in x["e"]["items"]], x["e"]["broken"]) for x in df.select("id", annotations.entries(F.col("a")).alias("e")).collect()}
    assert got == {i: plain_entries(a) for i, a, _ in rows}
    want = []
    for i, a, b in rows:
        (human, bad), (other, wrong) = plain_entries(a), plain_entries(b)
        human = [] if bad else human
        other = [] if wrong and not human else other
        first, second = ({(s, t): c for s, t, c in x} for x in (human, other))
        for k, at in enumerate(sorted({*first, *second})):
            h, o = first.get(at, ""), second.get(at, "")
            want.append((i, k, h if valid(h) else o if valid(o) else "", *at, "human_segment" if valid(h) else "segment"))
    assert sorted(tuple(x) for x in annotations.overlay(df, ["id"], "a", "b").collect()) == sorted(want)


def test_odd_annotations(spark):
    rows = [(1, "{"), (2, '{"subtasks":null}'), (3, '{"1 2":"a","1 2":"b"}'), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    assert annotations.nested_units(df, ["id"], "t").count() == 0
    got = {r["id"]: (r["s"]["items"], r["s"]["error"], r["l"]) for r in df.select("id", annotations.strict_intervals(F.col("t"), None, True).alias("s"), F.size(annotations.latin_intervals(F.col("t"))).alias("l")).collect()}
    assert [got[k][1] for k in (1, 4, 5)] == ["missing"] * 3 and got[3][2] in (1, 2)


def box(kind, content, large=False):
    return (struct.pack(">I4sQ", 1, kind, len(content) + 16) if large else struct.pack(">I4s", len(content) + 8, kind)) + content


def track(kind, *tables):
    return box(b"trak", box(b"mdia", box(b"hdlr", bytes(8) + kind + bytes(12)) + box(b"minf", box(b"stbl", b"".join(tables)))))


def test_boxes_by_hand(spark, tmp_path):
    sizes = box(b"stsz", bytes(8) + struct.pack(">I", 42))
    assert boxes.frame_count(box(b"mdat", bytes(100), True) + box(b"moov", track(b"soun", sizes) + track(b"vide", sizes))) == 42
    assert boxes.frame_count(box(b"moov", track(b"vide", box(b"stts", bytes(4) + struct.pack(">5I", 2, 3, 1, 4, 1))), True)) == 7
    whole = box(b"moov", track(b"vide", sizes))
    reasons = set()
    for k in range(len(whole)):
        try:
            boxes.frame_count(whole[:k])
        except boxes.BoxError as e:
            reasons.add(str(e))
    assert reasons == {"no_container", "invalid_box"}
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.mp4").write_bytes(whole)
    (tmp_path / "a/y.mp4").write_bytes(b"?" * 99)
    (tmp_path / "a/z.txt").write_bytes(whole)
    got = {r["path"][-5:]: (r["frames"], r["reason"]) for r in boxes.read_frame_counts(spark, str(tmp_path)).collect()}
    assert got == {"x.mp4": (42, None), "y.mp4": (None, "invalid_box")}
    counts = spark.createDataFrame([(1, 5), (1, 3), (2, None), (2, 9)], "e int, frames long")
    assert sorted(map(tuple, boxes.synchronized(counts, ["e"], "frames").collect())) == [(1, 3), (2, None)]


def test_damaged_boxes_never_hang_or_crash():
    r = random.Random(4)
    whole = box(b"ftyp", b"isom") + box(b"moov", track(b"soun", box(b"stsz", bytes(12))) + track(b"vide", box(b"stts", bytes(4) + struct.pack(">3I", 1, 3, 1))))
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(r.randint(1, 4)):
            data[r.randrange(len(data))] = r.choice([0, 1, 255, r.randrange(256)])
        try:
            assert boxes.frame_count(bytes(data)) > 0
        except boxes.BoxError:
            pass


def test_digests_don_t_depend_on_order_and_tell_one_row(spark):
    rows = [(i, None if i % 5 == 0 else f"x{i % 3}") for i in range(100)] + [(7, "x1")] * 3
    df = spark.createDataFrame(rows, "a int, b string")
    one = lambda d: d["digest"]
    whole = one(digests.table_digest(df, ["a", "b"]).first())
    assert whole == one(digests.table_digest(df.repartition(7, "b").orderBy(F.desc("a")), ["a", "b"]).first())
    others = [rows[1:], rows + [(7, "x1")], [*rows[:-1], (7, "x2")], rows + [(None, None)], [(*rows[0][:1], "x0"), *rows[1:]], []]
    assert len({whole, *(one(digests.table_digest(spark.createDataFrame(o, "a int, b string"), ["a", "b"]).first()) for o in others)}) == 7
    parts = {"p": df.where("a < 50"), "q": df.where("a >= 50")}
    keys = [digests.compose(dict(s), ["b"], ["a"], t).first() for s, t in ((parts.items(), {"x": "1", "y": "2"}), (reversed(parts.items()), {"y": "2", "x": "1"}), (parts.items(), {"x": "1", "y": "3"}))]
    assert keys[0] == keys[1] and keys[0]["content_digest"] == keys[2]["content_digest"] and keys[0]["input_key"] != keys[2]["input_key"]


@pytest.mark.parametrize(("n", "workers"), [(0, 4), (1, 4), (3, 8), (16, 4), (17, 4)])
def test_every_worker_has_as_many_steps_and_every_bin_comes(spark, n, workers):
    rows = ranks.dealt_bins(spark.range(n).withColumnRenamed("id", "bin"), "bin", workers, 3).collect()
    steps = -(-n // workers)
    assert sorted((r["step"], r["rank"]) for r in rows) == [(s, k) for s in range(steps) for k in range(workers)]
    assert {r["bin"] for r in rows if not r["again"]} == set(range(n)) and sum(not r["again"] for r in rows) == n
    if n > 9:
        other = ranks.dealt_bins(spark.range(n).withColumnRenamed("id", "bin"), "bin", workers, 4).collect()
        assert [tuple(r) for r in sorted(other)] != [tuple(r) for r in sorted(rows)]


def test_lengths_are_kept_by_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -4)], "id long, n long")
    make = lambda n, **config: {r["item"]: r["length"] for r in ranks.cached_lengths(df, "id", n, config, f"file://{tmp_path}").collect()}
    assert make(F.col("n"), a=1, b=2) == {1: 5, 2: -1, 3: -1} == make(F.lit(9), b=2, a=1)
    assert make(F.lit(9), a=1, b=3) == {1: 9, 2: 9, 3: 9}
    kept = ranks.cached_lengths(df, "id", F.lit(0), {"a": 1, "b": 2}, f"file://{tmp_path}")
    assert [r["item"] for r in ranks.length_failures(kept).collect()] == [2, 3]
