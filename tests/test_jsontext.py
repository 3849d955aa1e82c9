"""Repair, stop places and spans of JSON texts against readers that go letter by letter, on random damage."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import jsontext


def plan(r):
    word = lambda: "".join(r.choices(['a', '"', "\\", "{", "}", "[", "]", ",", "ü", " "], k=r.randint(1, 5)))
    items = []
    for i in range(r.randint(0, 4)):
        action = {"caption": word() + "x"}
        if r.random() < 0.8:
            action["segments"] = [{"index": k + 1, "segment": {"caption": word() + "y"}} for k in range(r.randint(1, 4))]
        items.append({"index": i + 1, "action": action})
    return json.dumps({"initial_plan": items}, ensure_ascii=False, separators=r.choice([(",", ":"), (", ", ": ")]))


def damaged(r, text):
    for _ in range(r.randint(0, 2)):
        k = r.randrange(len(text) + 1)
        text = r.choice([text[:k], text[:k] + text[k + 1 :], text[:k] + r.choice('"\\{}[],') + text[k:], text.replace('","segments"', '"}"segments"'), text.replace('","segments"', '"}segments"', 1), text + r.choice([" ", ",", "}", "x"])])
        text = text or " "
    return text


def letters(text, start=0):
    """Every bracket outside strings, and whether a string is open at the end, letter by letter."""
    out, inside, skip = [], False, False
    for at in range(start, len(text)):
        c = text[at]
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "[]{}":
            out.append((at, c))
    return out, inside


def stacked(text, start=0):
    """(place, bracket, stack after it) up to the first that doesn't fit, and whether all fit, and an open string."""
    found, inside = letters(text, start)
    stack, out = "", []
    for at, c in found:
        if c in "[{":
            stack += c
        elif stack[-1:] == {"]": "[", "}": "{"}[c]:
            stack = stack[:-1]
        else:
            return out, False, inside
        out.append((at, c, stack))
    return out, True, inside


def test_brackets_on_random_damage():
    r = random.Random(1)
    for _ in range(4000):
        text = damaged(r, plan(r))
        want, fits, inside = stacked(text)
        got = list(jsontext.brackets(text))
        assert [g for g in got if g[2] is not None] == want
        assert (got[-1][2] is None if got else False) == (not fits or inside)


def test_repairs_are_json_and_keep_what_was_whole():
    r = random.Random(2)
    mended = 0
    for _ in range(4000):
        whole = plan(r)
        text = damaged(r, whole)
        out = jsontext.repair(text)
        if out is None:
            continue
        mended += 1
        value, steps = out
        names = [s["operation"] for s in steps]
        stack, fits, inside = stacked(value)
        assert fits
        if "drop_incomplete_trailing_initial_plan_item" in names or "append_missing_eof_closers" in names:
            json.loads(value)
            assert not inside and stack[-1][2] == ""
    assert mended > 500


def test_cut_plans_come_back():
    r = random.Random(3)
    for _ in range(500):
        text = plan(r)
        value = json.loads(text)
        ends = [at + 1 for at, c, after in stacked(text)[0] if c == "}" and after == "{["]
        for k in range(len(text)):
            out = jsontext.repair(text[:k])
            if out and out[1][-1]["operation"].startswith("drop"):
                n = sum(e <= k for e in ends)
                assert json.loads(out[0]) == {"initial_plan": value["initial_plan"][:n]} and n > 0


def test_stop_places():
    r = random.Random(4)
    seen = set()
    for _ in range(3000):
        text = r.choice(["", "plan: ", "no ["]) + damaged(r, plan(r))
        actions, segments = r.randint(1, 3), r.randint(1, 3)
        got = jsontext.stop(text, actions, segments)
        start = text.find("{")
        want = None
        if start >= 0:
            n = m = 0
            ends = {}
            for at, c, after in stacked(text, start)[0]:
                if c == "{" and after == "{[{" and n >= actions and "action" in ends:
                    want = ("maximum_actions", ends["action"], n, 0)
                elif c == "{" and after == "{[{{[{" and m >= segments and "segment" in ends:
                    want = ("maximum_segments_per_action", ends["segment"], n, m)
                elif c == "}" and after == "{[{{[":
                    m, ends["segment"] = m + 1, at + 1
                elif c == "}" and after == "{[":
                    n, m, ends = n + 1, 0, {"action": at + 1}
                if want:
                    break
        assert got == want
        seen.add(want and want[0])
    assert len(seen) == 3


def test_spans_cut_exactly_the_values_out():
    r = random.Random(5)
    pointer = lambda path: "/" + "/".join(str(p).replace("~", "~0").replace("/", "~1") for p in path)

    def value(depth):
        kind = r.randrange(6) if depth else r.randrange(4)
        if kind < 4:
            return [None, r.randint(-5, 500), r.choice(["ü\"", "a/b", "", "~"]), r.choice([True, 2.5])][kind]
        return [value(depth - 1) for _ in range(r.randint(0, 3))] if kind == 4 else {r.choice(["a", "b/c", "~", "é\"", ""]) + str(k): value(depth - 1) for k in range(r.randint(0, 3))}

    def paths(v, at=()):
        yield at, v
        for k, child in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from paths(child, (*at, k))

    for _ in range(800):
        v = {"r": value(3), "s": value(2)}
        every = [p for p in paths(v) if p[0]]
        some = dict(r.sample(every, min(len(every), 3)))
        names = [pointer(p) for p in some]
        text, found, error = jsontext.spans(json.dumps(v), names)
        if any(a != b and b[: len(a)] == a for a in some for b in some):
            assert error == "pointer_inside_another"
            continue
        assert error is None and text == json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        assert {p: text[a:b] for a, b, p in found} == {pointer(p): jsontext.compact(x) for p, x in some.items()}


def test_markers(spark):
    kind = "id int, t string, s array<struct<begin:int,finish:int,pointer:string>>"
    rows = [(1, "abcdef", [(3, 5, "/b"), (0, 1, "/a")]), (2, "abc", [(0, 2, "/a"), (1, 3, "/b")]), (3, "abc", []), (4, "<|V5MASK_00_END|>", [(0, 1, "/a")]), (5, "x" * 200, [(k, k + 1, f"/{k}") for k in range(65)]), (6, "ab", [(1, 3, "/a")]), (7, "ab", [(1, 1, "/a")])]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, kind).select("id", jsontext.marked(F.col("t"), F.col("s"))).collect()}
    assert got == {1: "<|V5MASK_00_START|>a<|V5MASK_00_END|>bc<|V5MASK_01_START|>de<|V5MASK_01_END|>f", 2: None, 3: "abc", 4: None, 5: None, 6: None, 7: None}


def test_long_and_odd_texts(spark):
    deep = '{"initial_plan":[' + '{"index":1,"action":{"caption":"x"}},' * 40_000
    rows = [(1, deep), (2, None), (3, ""), (4, '"' * 99_999), (5, "\\" * 100_000 + '"')]
    df = spark.createDataFrame(rows, "id int, t string").select("id", jsontext.repaired(F.col("t")).alias("r"), jsontext.stop_place(F.col("t"), 3, 3).alias("s"), jsontext.output_class(F.col("t")).alias("c"))
    got = {r["id"]: r for r in df.collect()}
    assert len(json.loads(got[1]["r"]["repaired"])["initial_plan"]) == 40_000 and got[1]["s"]["n_actions"] == 3
    assert all(got[k]["r"]["repaired"] is None for k in (2, 3, 4, 5)) and got[2]["c"] == "empty"
    with pytest.raises(ValueError, match="positive"):
        jsontext.stop_place(F.col("t"), 0, 1)
