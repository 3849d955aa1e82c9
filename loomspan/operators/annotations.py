"""Annotations written as JSON maps or lists, flat or nested, as rows of units.

A level is a map from "start end" to a caption, or a list of objects with frames and a
caption; which of them a text is, is found out for each row, and so is what in it can't
be read. Types are those of the JSON: a number is no caption, a truth value no frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import bound, interval_key, is_latin_caption

_ITEMS = "array<struct<start:bigint,finish:bigint,caption:string>>"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _get(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _is_object(value: Column) -> Column:
    return F.startswith(_kind(value), F.lit("OBJECT"))


def _words(value: Column) -> Column:
    """The text of a JSON string; empty for anything else."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise("")


def _whole(value: Column) -> Column:
    """A JSON whole number of 64 bits; null for anything else."""
    return F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def _own_objects(values: Column) -> Column:
    """The objects of an array that may be none."""
    return F.filter(F.coalesce(values, F.array().cast("array<variant>")), _is_object)


def entries(text: Column) -> Column:
    """(items, broken): the entries of a level that can be read, in their order, and whether there are others.

    A null text, a JSON null and empty maps and lists have no entries. A text that is no
    JSON map or list is broken. In a list, caption_en counts before caption.
    """
    pairs = F.map_entries(F.from_json(text, "map<string,variant>"))
    keyed = F.transform(pairs, lambda e: F.struct(interval_key(e["key"]).alias("at"), _words(e["value"]).alias("caption")))
    listed = F.transform(
        F.from_json(text, "array<variant>"),
        lambda v: F.struct(
            F.when(_is_object(v) & _whole(_get(v, "start_frame")).isNotNull() & _whole(_get(v, "end_frame")).isNotNull(), F.struct(_whole(_get(v, "start_frame")).alias("start"), _whole(_get(v, "end_frame")).alias("end"))).alias("at"),
            _words(F.coalesce(_get(v, "caption_en"), _get(v, "caption"))).alias("caption"),
        ),
    )
    return bound(F.coalesce(keyed, listed), lambda both: _read(text, both))


def _read(text: Column, both: Column) -> Column:
    items = F.transform(F.filter(both, lambda e: e["at"].isNotNull()), lambda e: F.struct(e["at"]["start"].alias("start"), e["at"]["end"].alias("finish"), e["caption"].alias("caption")))
    nothing = F.coalesce(F.trim(text) == "null", F.lit(True))
    broken = ~nothing & F.coalesce(F.exists(both, lambda e: e["at"].isNull()), F.lit(True))
    return F.struct(F.coalesce(items, F.array().cast(_ITEMS)).alias("items"), broken.alias("broken"))


def level_units(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, unit, caption, start, finish) of a flat level, in the order in which it is written; a level with anything broken has none."""
    own = df.select(*key, entries(F.col(text)).alias("e")).where("not e.broken")
    return own.select(*key, F.posexplode("e.items").alias("unit", "i")).select(*key, "unit", "i.caption", "i.start", "i.finish")


def overlay(df: DataFrame, key: list[str], first: str, second: str) -> DataFrame:
    """(key, unit, caption, start, finish, source) of two flat levels over each other, by exact interval.

    The first level's caption counts where it is valid, else the second's, else none; of
    entries with the same interval the last one does. A broken first level counts as
    empty; a broken second one empties the result if the first has no entries, and keeps
    what can be read of it otherwise. Units are numbered by start and end.
    """
    own = df.select(*key, entries(F.col(first)).alias("a"), entries(F.col(second)).alias("b"))
    human = F.when(F.col("a.broken"), F.array().cast(_ITEMS)).otherwise(F.col("a.items"))
    other = F.when(F.col("b.broken") & (F.size(human) == 0), F.array().cast(_ITEMS)).otherwise(F.col("b.items"))
    side = lambda items, k: F.transform(items, lambda e, i: F.struct(F.lit(k).alias("side"), i.alias("place"), e.alias("e")))
    rows = own.select(*key, F.explode(F.concat(side(human, 0), side(other, 1))).alias("x")).select(*key, "x.side", "x.place", "x.e.*")
    last = lambda k: F.max_by("caption", F.when(F.col("side") == k, F.col("place")))
    units = rows.groupBy(*key, "start", "finish").agg(last(0).alias("human"), last(1).alias("other"))
    valid = {c: F.coalesce(is_latin_caption(F.col(c)), F.lit(False)) for c in ("human", "other")}
    chosen = F.when(valid["human"], F.col("human")).when(valid["other"], F.col("other")).otherwise("")
    by_time = Window.partitionBy(*key).orderBy("start", "finish")
    return units.select(*key, (F.row_number().over(by_time) - 1).alias("unit"), chosen.alias("caption"), "start", "finish", F.when(valid["human"], "human_segment").otherwise("segment").alias("source"))


def nested_units(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, level, unit, caption, start, finish) of subtasks with actions with segment_details, levels 2, 1 and 0.

    Units of levels 1 and 0 are numbered through all their parents; those of level 2 by
    their place among all entries of the list. Entries that are no objects and lists that
    are none are left out, captions that are no texts are empty, frames that are no whole
    numbers null. A text that is no object has no units.
    """
    subtasks = _get(F.try_parse_json(F.col(text)), "subtasks", "array<variant>")
    own = df.select(*key, subtasks.alias("s"))
    actions = F.flatten(F.transform(_own_objects(F.col("s")), lambda v: _own_objects(_get(v, "actions", "array<variant>"))))
    details = F.flatten(F.transform(F.col("a"), lambda v: _own_objects(_get(v, "segment_details", "array<variant>"))))
    own = own.withColumn("a", actions).withColumn("d", details)
    numbered = lambda c, level: F.filter(F.transform(c, lambda v, i: F.struct(F.lit(level).alias("level"), i.alias("unit"), v.alias("v"))), lambda x: _is_object(x["v"]))
    every = F.concat(numbered(F.coalesce(F.col("s"), F.array().cast("array<variant>")), 2), numbered(F.col("a"), 1), numbered(F.col("d"), 0))
    v = F.col("x.v")
    return own.select(*key, F.explode(every).alias("x")).select(*key, "x.level", "x.unit", _words(_get(v, "caption_en")).alias("caption"), _whole(_get(v, "start_frame")).alias("start"), _whole(_get(v, "end_frame")).alias("finish"))


_KEY = r"^\s*(\d{1,18})\s+(\d{1,18})\s*$"


def _keyed(text: Column) -> Column:
    """Entries of a map: interval (null if it is none) and trimmed caption."""
    pairs = F.map_entries(F.from_json(text, "map<string,variant>"))
    number = lambda k, i: F.try_to_number(F.regexp_extract(k, _KEY, i), F.lit("9" * 18)).cast("bigint")
    return F.transform(pairs, lambda e: F.struct(F.when(e["key"].rlike(_KEY), number(e["key"], 1)).alias("start"), F.when(e["key"].rlike(_KEY), number(e["key"], 2)).alias("finish"), F.trim(_words(e["value"])).alias("caption")))


def latin_intervals(text: Column) -> Column:
    """Entries (start, finish, caption) of a map with a valid caption and an end behind the start, sorted; anything but a map has none."""
    fits = lambda e: (e["finish"] > e["start"]) & is_latin_caption(e["caption"])
    return F.array_sort(F.filter(F.coalesce(_keyed(text), F.array().cast(_ITEMS)), lambda e: F.coalesce(fits(e), F.lit(False))))


def strict_intervals(text: Column, total: Column | None = None, required: bool = False) -> Column:
    """(items, error): all entries of a map, sorted, or the first thing in its order that is wrong.

    invalid_entry: no two whole numbers, or no caption; invalid_interval: no start below
    the end; beyond_total: an end behind total (if that is known); missing: no entry
    although one is required. Anything but a map counts as an empty one.
    """
    total = F.lit(None).cast("bigint") if total is None else total
    own = F.coalesce(_keyed(text), F.array().cast(_ITEMS))
    wrong = lambda e: F.when(e["start"].isNull() | e["finish"].isNull() | (e["caption"] == ""), "invalid_entry").when(e["start"] >= e["finish"], "invalid_interval").when(e["finish"] > total, "beyond_total")
    first = F.get(F.filter(F.transform(own, wrong), lambda x: x.isNotNull()), F.lit(0))
    error = F.coalesce(first, F.when(F.size(own) == 0, F.lit("missing")) if required else F.lit(None).cast("string"))
    return F.struct(F.when(error.isNull(), F.array_sort(own)).alias("items"), error.alias("error"))


def alignable(actions: Column, segments: Column) -> Column:
    """Whether each of two arrays of (start, finish) has entries and each entry overlaps one of the other."""
    return bound(F.struct(actions.alias("a"), segments.alias("b")), lambda x: _alignable(x["a"], x["b"]))


def _alignable(actions: Column, segments: Column) -> Column:
    meets = lambda a, b: F.forall(a, lambda x: F.exists(b, lambda y: F.least(x["finish"], y["finish"]) > F.greatest(x["start"], y["start"])))
    return (F.size(actions) > 0) & (F.size(segments) > 0) & meets(actions, segments) & meets(segments, actions)
