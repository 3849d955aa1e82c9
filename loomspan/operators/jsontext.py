"""JSON that a model wrote: repair of damaged plans, stop places, classes of text, spans of values.

A text is read once by a pattern whose pieces are whole strings and single brackets, so
quotes and brackets inside strings are never seen apart; the open brackets are a stack.
All work on one text at a time in Arrow batches, in time linear in the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import bound, unfenced

_PIECE = re.compile(r'"(?:[^"\\]|\\.)*+("|\\?\Z)|[\[\]{}]', re.S)
_OPENS = {"]": "[", "}": "{"}
_CLOSES = {"[": "]", "{": "}"}
#: The two kinds of damage between an action's caption and its segments, and what they stand for.
_EARLY_CLOSE = re.compile(r'("caption"\s*:\s*"(?:[^"\\]|\\.)*")\s*}\s*("segments"\s*:)')
_LOST_QUOTE = re.compile(r'("caption"\s*:\s*"(?:[^"\\]|\\.)*")\s*}\s*segments"\s*:')
#: Where a plan's items and an item's segments stand, and the deepest nesting that is closed.
_ITEMS, _SEGMENTS, _DEEPEST = "{[", "{[{{[", 8


def brackets(text: str, start: int = 0) -> Iterator[tuple[int, str, str | None]]:
    """(place, bracket, brackets that are open after it) in order; the last is None for a closer that closes nothing, or for a string without end (bracket ``"``), and nothing follows."""
    stack = ""
    for piece in _PIECE.finditer(text, start):
        mark = piece[0][0]
        if mark == '"':
            if piece[1] != '"':
                yield piece.start(), mark, None
                return
        elif mark in _CLOSES:
            stack += mark
            yield piece.start(), mark, stack
        else:
            if stack[-1:] != _OPENS[mark]:
                yield piece.start(), mark, None
                return
            stack = stack[:-1]
            yield piece.start(), mark, stack


def _loads(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def repair(text: str) -> tuple[str, list[dict]] | None:
    """A plan's text with its punctuation mended, and what was done; None if nothing was, or if it can't be told what is meant."""
    done: list[dict] = []
    for pattern, put, name in ((_EARLY_CLOSE, r"\1,\2", "remove_premature_action_close_before_segments"), (_LOST_QUOTE, r'\1,"segments":', "restore_segments_open_quote_and_separator")):
        text, n = pattern.subn(put, text)
        if n:
            done.append({"operation": name, "count": n})
    stack, whole, cut = "", True, None
    for at, mark, after in brackets(text):
        if after is None and mark != '"':
            return None
        whole = after is not None
        stack = after if whole else stack
        if mark == "}" and after == _ITEMS:
            cut = at + 1
    if not whole or len(stack) > _DEEPEST:
        if cut is None or not _loads(text[:cut] + "]}"):
            return None
        return text[:cut] + "]}", [*done, {"operation": "drop_incomplete_trailing_initial_plan_item", "cut": cut}]
    if stack:
        suffix = "".join(_CLOSES[b] for b in reversed(stack))
        text = text.rstrip()
        if text.endswith(","):
            text = text[:-1]
            done.append({"operation": "strip_trailing_separator_comma"})
        text += suffix
        if not _loads(text):
            return None
        done.append({"operation": "append_missing_eof_closers", "suffix": suffix})
    return (text, done) if done else None


_REPAIRED = "repaired string, operations array<struct<operation:string,count:int,cut:int,suffix:string>>"


def _repaired(texts: pd.Series) -> pd.DataFrame:
    rows = [None if t is None else repair(t) for t in texts]
    full = lambda o: {"operation": o["operation"], "count": o.get("count"), "cut": o.get("cut"), "suffix": o.get("suffix")}
    return pd.DataFrame([(None, None) if r is None else (r[0], [full(o) for o in r[1]]) for r in rows], columns=["repaired", "operations"])


def repaired(text: Column) -> Column:
    """(repaired, operations) of a plan's text, out of its code fence: punctuation mended, captions never touched; nulls if nothing could be done or had to be."""
    return F.pandas_udf(_repaired, _REPAIRED)(unfenced(text))


def stop(text: str, actions: int, segments: int) -> tuple[str, int, int, int] | None:
    """(reason, place, whole actions, whole segments of the last) before the first item beyond the limits."""
    start = text.find("{")
    n_actions = n_segments = 0
    ends: dict[str, int] = {}
    for at, mark, after in brackets(text, start) if start >= 0 else ():
        if after is None:
            return None
        if mark == "{":
            if after[:-1] == _ITEMS and n_actions >= actions and _ITEMS in ends:
                return "maximum_actions", ends[_ITEMS], n_actions, 0
            if after[:-1] == _SEGMENTS and n_segments >= segments and _SEGMENTS in ends:
                return "maximum_segments_per_action", ends[_SEGMENTS], n_actions, n_segments
        elif mark == "}" and after == _SEGMENTS:
            n_segments += 1
            ends[_SEGMENTS] = at + 1
        elif mark == "}" and after == _ITEMS:
            n_actions, n_segments = n_actions + 1, 0
            ends = {_ITEMS: at + 1}
    return None


def stop_place(text: Column, actions: int, segments: int) -> Column:
    """(reason, cut, n_actions, n_segments): where a plan's text goes beyond so many actions, or segments of one; nulls where it doesn't or where brackets don't fit before."""

    @F.pandas_udf("reason string, cut int, n_actions int, n_segments int")
    def find(texts: pd.Series) -> pd.DataFrame:
        none = (None, None, None, None)
        return pd.DataFrame([none if t is None else stop(t, actions, segments) or none for t in texts], columns=["reason", "cut", "n_actions", "n_segments"], dtype=object)

    if min(actions, segments) < 1:
        raise ValueError("limits have to be positive")
    return find(text)


def raw_class(text: str) -> str:
    """What an output is: clean JSON, JSON and something behind it, or neither."""
    text = text.strip()
    if not text:
        return "empty"
    try:
        rest = text[json.JSONDecoder().raw_decode(text)[1] :].strip()
    except (ValueError, RecursionError):
        return "no_json_prefix"
    if not rest:
        return "clean_json"
    if len(rest) <= 8:
        return "tiny_trailing_suffix"
    if "trial_id" in rest:
        return "trailing_trial_id"
    return "repeated_json" if rest[0] in "{[" else "other_trailing_text"


def _classes(texts: pd.Series) -> pd.Series:
    return pd.Series([raw_class("" if t is None else t) for t in texts], dtype=object)


def output_class(text: Column) -> Column:
    """The class of each output; a null is empty."""
    return F.pandas_udf(_classes, "string")(text)


def json_object(text: Column) -> Column:
    """The value of a text, out of its code fence, that is one JSON object, as a variant; null for anything else."""
    value = F.try_parse_json(unfenced(text))
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)


def compacted(plan: Column, actions: int = 12, segments: int = 4) -> Column:
    """A plan without repeated actions and segments and with at most so many, in order, and counts of what was left out.

    plan is array<struct<caption string, segments array<string>>>; null segments are an
    action alone, an empty list is left out. Captions are the same if they are but for
    case and white space. (kept, repeated_actions, repeated_segments, above_actions,
    above_segments, n_alone, n_joint).
    """
    key = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")

    def first(items: Column, most: int) -> Column:
        """(kept, repeated, above) of captions."""
        start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("repeated"), F.lit(0).alias("above"))

        def step(acc: Column, c: Column) -> Column:
            return bound(key(c), lambda k: taken_in(acc, c, k))

        def taken_in(acc: Column, c: Column, k: Column) -> Column:
            known, full = F.array_contains(acc["seen"], k), F.size(acc["kept"]) >= most
            return F.struct(
                F.when(known | full, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(c))).alias("kept"),
                F.when(known | full, acc["seen"]).otherwise(F.concat(acc["seen"], F.array(k))).alias("seen"),
                (acc["repeated"] + known.cast("int")).alias("repeated"),
                (acc["above"] + (~known & full).cast("int")).alias("above"),
            )

        return F.aggregate(items, start, step)

    kind = "array<struct<caption:string,segments:array<string>>>"
    start = F.struct(F.array().cast(kind).alias("kept"), F.array().cast("array<string>").alias("seen"), *(F.lit(0).alias(c) for c in ("repeated_actions", "repeated_segments", "above_actions", "above_segments")))

    def step(acc: Column, a: Column) -> Column:
        inner = first(F.coalesce(a["segments"], F.array().cast("array<string>")), segments)
        return bound(F.struct(key(a["caption"]).alias("key"), inner.alias("inner")), lambda x: joined(acc, a, x["key"], x["inner"]))

    def joined(acc: Column, a: Column, k: Column, inner: Column) -> Column:
        known, full = F.array_contains(acc["seen"], k), F.size(acc["kept"]) >= actions
        taken = ~known & ~full
        some = a["segments"].isNull() | (F.size(inner["kept"]) > 0)
        own = F.struct(a["caption"].alias("caption"), F.when(a["segments"].isNotNull(), inner["kept"]).alias("segments"))
        return F.struct(
            F.when(taken & some, F.concat(acc["kept"], F.array(own))).otherwise(acc["kept"]).alias("kept"),
            F.when(taken, F.concat(acc["seen"], F.array(k))).otherwise(acc["seen"]).alias("seen"),
            (acc["repeated_actions"] + known.cast("int")).alias("repeated_actions"),
            (acc["repeated_segments"] + F.when(taken, inner["repeated"]).otherwise(0)).alias("repeated_segments"),
            (acc["above_actions"] + (~known & full).cast("int")).alias("above_actions"),
            (acc["above_segments"] + F.when(taken, inner["above"]).otherwise(0)).alias("above_segments"),
        )

    joint = F.size(F.filter(plan, lambda a: a["segments"].isNotNull()))
    finish = lambda acc: F.struct(*(acc[c].alias(c) for c in ("kept", "repeated_actions", "repeated_segments", "above_actions", "above_segments")), (F.size(plan) - joint).alias("n_alone"), joint.alias("n_joint"))
    return F.aggregate(plan, start, step, finish)


def _caption(node: object) -> str | None:
    own = node.get("caption") if isinstance(node, dict) else None
    return own if isinstance(own, str) and own.strip() else None


def canonical_plan(text: str, joint: bool) -> tuple[str, dict[str, int]] | None:
    """A plan's fields alone, numbered anew, as compact JSON, and counts of what went; None if nothing had to, or nothing is left. joint: actions need segments."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    source = value.get("initial_plan") if isinstance(value, dict) else None
    if not isinstance(source, list):
        return None
    counts = dict.fromkeys(("dropped_items", "dropped_segments", "projected_segments", "removed_keys"), 0)
    plan: list[dict] = []
    for item in source:
        action = item.get("action") if isinstance(item, dict) else None
        caption = _caption(action)
        if caption is None:
            counts["dropped_items"] += 1
            continue
        counts["removed_keys"] += len(item.keys() - {"index", "action", "segment"}) + len(action.keys() - {"caption", "segments"})
        node: dict = {"caption": caption}
        if joint:
            given = action.get("segments")
            if not isinstance(given, list):
                beside = item.get("segment")
                given = [{"segment": beside}] if isinstance(beside, dict) else []
                counts["projected_segments"] += len(given)
            own = []
            for one in given:
                segment = one.get("segment") if isinstance(one, dict) else None
                name = _caption(segment)
                if name is None:
                    counts["dropped_segments"] += 1
                    continue
                counts["removed_keys"] += len(one.keys() - {"index", "segment"}) + len(segment.keys() - {"caption"})
                own.append({"index": len(own) + 1, "segment": {"caption": name}})
            if not own:
                counts["dropped_items"] += 1
                continue
            node["segments"] = own
        plan.append({"index": len(plan) + 1, "action": node})
    out = compact({"initial_plan": plan})
    return None if not plan or out == compact(value) else (out, counts)


def canonical(text: Column, joint: bool) -> Column:
    """(plan, dropped_items, dropped_segments, projected_segments, removed_keys) of a plan's text, out of its code fence; nulls if nothing had to be changed or nothing is left."""
    names = ["plan", "dropped_items", "dropped_segments", "projected_segments", "removed_keys"]

    @F.pandas_udf(", ".join(["plan string", *(f"{c} int" for c in names[1:])]))
    def made(texts: pd.Series) -> pd.DataFrame:
        found = [None if t is None else canonical_plan(t, joint) for t in texts]
        return pd.DataFrame([[None] * 5 if f is None else [f[0], *f[1].values()] for f in found], columns=names, dtype=object)

    return made(unfenced(text))


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _parts(pointer: str) -> tuple[str, ...]:
    return tuple(p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/"))


def _span(value: object, parts: Sequence[str]) -> tuple[int, int] | None:
    """Begin and end, in the compact text of value, of what a pointer's names lead to."""
    at = 0
    for name in parts:
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        at += 1
        for key, child in items:
            at += len(compact(key)) + 1 if isinstance(value, dict) else 0
            if str(key) == name:
                value = child
                break
            at += len(compact(child)) + 1
        else:
            return None
    return at, at + len(compact(value))


def spans(text: str, pointers: Sequence[str]) -> tuple[str | None, list[tuple[int, int, str]] | None, str | None]:
    """The compact text of a JSON value, keys in their order, and the spans of the pointers' values; or what is wrong."""
    try:
        value = json.loads(text)
    except ValueError:
        return None, None, "invalid_json"
    if any(not p.startswith("/") for p in pointers):
        return None, None, "invalid_pointer"
    wanted = {_parts(p): p for p in pointers}
    if len(wanted) < len(pointers):
        return None, None, "repeated_pointer"
    if any(p[:k] in wanted for p in wanted for k in range(1, len(p))):
        return None, None, "pointer_inside_another"
    found = [(_span(value, parts), "/" + "/".join(p.replace("~", "~0").replace("/", "~1") for p in parts)) for parts in wanted]
    if any(place is None for place, _ in found):
        return None, None, "missing_pointer"
    return compact(value), sorted((*place, p) for place, p in found), None


def _spans(texts: pd.Series, pointers: pd.Series) -> pd.DataFrame:
    rows = []
    for text, names in zip(texts, pointers, strict=True):
        out, found, error = spans("" if text is None else text, [] if names is None else list(names))
        rows.append((out, None if found is None else [{"begin": a, "finish": b, "pointer": p} for a, b, p in found], error))
    return pd.DataFrame(rows, columns=["text", "spans", "error"], dtype=object)


def value_spans(text: Column, pointers: Column) -> Column:
    """The compact text of each JSON value and the spans, in code points, of the values that its pointers name; or an error."""
    return F.pandas_udf(_spans, "text string, spans array<struct<begin:int,finish:int,pointer:string>>, error string")(text, pointers)


#: The markers of the k-th span, and how many there are.
MARKS = ("<|V5MASK_", "_START|>", "_END|>")
MOST_MARKS = 64


def marked(text: Column, spans: Column) -> Column:
    """The text with a marker before and after each span; null if there are too many, if they overlap or are empty, or if a marker stands in the text."""
    own = F.array_sort(spans)
    number = lambda k: F.lpad(k.cast("string"), 2, "0")
    before = lambda k: F.when(k > 0, F.get(own, k - 1)["finish"]).otherwise(0)
    between = lambda a, b: F.substr(text, a + 1, b - a)
    parts = F.transform(own, lambda s, k: F.concat(between(before(k), s["begin"]), F.lit(MARKS[0]), number(k), F.lit(MARKS[1]), between(s["begin"], s["finish"]), F.lit(MARKS[0]), number(k), F.lit(MARKS[2])))
    fits = F.forall(F.transform(own, lambda s, k: (s["begin"] >= before(k)) & (s["finish"] > s["begin"]) & (s["finish"] <= F.length(text))), lambda x: x)
    names = F.transform(F.sequence(F.lit(0), F.size(own) - 1), number)
    clash = F.exists(names, lambda n: F.contains(text, F.concat(F.lit(MARKS[0]), n, F.lit(MARKS[1]))) | F.contains(text, F.concat(F.lit(MARKS[0]), n, F.lit(MARKS[2]))))
    last = F.coalesce(F.element_at(F.transform(own, lambda s: s["finish"]), -1), F.lit(0))
    whole = F.concat(F.array_join(parts, ""), between(last, F.length(text)))
    return F.when(F.size(own) == 0, text).when((F.size(own) <= MOST_MARKS) & fits & ~clash, whole)

