"""References to images and videos, sizes and lengths of what they show, and other small readings of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import caption_forms
from loomspan.operators.contracts import Node, document

# Failures by the code of their source.
_CODES = ("1.1", "1.2", "1.3", "1.4", "1.5", "2.1", "2.2", "3.1", "4.1", "4.2", "4.3", "5.1", "6.1", "7.1", "8.1")


def video_ref(text: Column) -> Column:
    """(path, start, end) of a reference: the JSON of a path or of an object with path (or video), start_frame and end_frame; null for others.

    Frames are whole numbers or missing; a truth value or a fraction makes the reference none.
    """
    node = document(text)
    path = F.when(node.kind() == "STRING", node.string()).otherwise(F.when(node.at("path").value.isNotNull(), node.at("path").string()).otherwise(node.at("video").string()))
    path = F.trim(path)
    frame = lambda n: node.at(n)
    fits = lambda n: n.value.isNull() | F.is_variant_null(n.value) | n.whole().isNotNull()
    plain = (node.kind() == "STRING") & (path != "")
    whole = node.is_object() & (F.coalesce(path, F.lit("")) != "") & fits(frame("start_frame")) & fits(frame("end_frame"))
    none = F.lit(None).cast("bigint")
    return F.when(plain, F.struct(path.alias("path"), none.alias("start"), none.alias("end"))).when(whole, F.struct(path.alias("path"), frame("start_frame").whole().alias("start"), frame("end_frame").whole().alias("end")))


def image_refs(text: Column) -> Column:
    """An image field's references as JSON texts: of a list its entries, of anything else itself, without nulls and empty texts; null for what is none of these."""
    node = document(text)
    known = lambda n: ~F.is_variant_null(n.value) & ~((n.kind() == "STRING") & (F.trim(n.string()) == ""))
    one = F.struct(node.text.alias("text"), node.value.alias("value"))
    items = F.when(node.is_list(), node.items()).when((node.kind() == "STRING") | node.is_object(), F.array(one))
    kept = F.filter(items, lambda x: F.coalesce(known(Node(x["text"], x["value"])), F.lit(False)))
    empty = text.isNull() | F.coalesce(F.is_variant_null(node.value), F.lit(False))
    return F.when(empty, F.array().cast("array<string>")).otherwise(F.transform(kept, lambda x: F.to_json(x["value"])))


def resized(height: Column, width: Column, long_edge: int = 640, factor: int = 32, most: int = 589_824) -> Column:
    """(height, width) of an image made smaller in its own shape, both sides multiples of factor; null where a side is less than factor."""
    scale = F.least(F.lit(1.0), F.lit(float(long_edge)) / F.greatest(height, width))
    h, w = height * scale, width * scale
    cap = F.when(h * w > most, F.sqrt(F.lit(float(most)) / (h * w))).otherwise(1.0)
    side = lambda x: F.greatest(F.lit(factor), F.floor(x * cap / factor) * factor).cast("int")
    return F.when((height >= factor) & (width >= factor), F.struct(side(h).alias("height"), side(w).alias("width")))


def context_tokens(characters: Column, images: Column, per_token: int = 3, per_image: int = 400, spare: int = 256) -> Column:
    """An estimate of a sample's tokens from its characters and images."""
    return F.floor((characters + per_token - 1) / per_token).cast("long") + per_image * images + spare


def failure_code(text: Column) -> Column:
    """The known code at the beginning of a failure's text; null for others."""
    code = F.regexp_extract(text, r"^\s*([1-8]\.[1-5])(?![0-9])", 1)
    return F.when(code.isin(*_CODES), code)


def fraction(text: Column) -> Column:
    """(numerator, denominator) in lowest terms of a positive "a", "a/b" or decimal number of up to nine digits on either side; null for others."""
    digits = r"^\s*([0-9]{1,9})(?:/([0-9]{1,9})|\.([0-9]{1,9}))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(text, digits, i), F.lit("")).cast("bigint")
    places = F.length(F.regexp_extract(text, digits, 3))
    ten = F.pow(F.lit(10), places).cast("bigint")
    top = F.when(places > 0, part(1) * ten + part(3)).otherwise(part(1))
    below = F.when(places > 0, ten).otherwise(F.coalesce(part(2), F.lit(1)))
    # Euclid's rule on numbers below 10**18 needs at most 90 steps
    start = F.struct(top.alias("a"), below.alias("b"))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, lambda p, _: F.when(p["b"] > 0, F.struct(p["b"].alias("a"), F.pmod(p["a"], p["b"]).alias("b"))).otherwise(p), lambda p: p["a"])
    return F.when(text.rlike(digits) & (top > 0) & (below > 0), F.struct(F.call_function("div", top, gcd).alias("numerator"), F.call_function("div", below, gcd).alias("denominator")))


def detailed_caption(fallback: Column, instruction: Column, detailed: Column, task: Column) -> Column:
    """The detailed instruction where it shares more word forms with the task than the short one does, else the fallback; the fallback too where one is missing."""
    shared = lambda c: F.size(F.array_intersect(caption_forms(c), caption_forms(task)))
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(there(instruction) & there(detailed) & there(task) & (shared(detailed) > shared(instruction)), detailed).otherwise(fallback)


def merge_identity(media: Column, anchor: Column, level: Column, profile: Column, views: Column) -> Column:
    """Hash of what makes two rows of different runs the same sample: canonical JSON with sorted names and views."""
    quoted = lambda c: F.coalesce(F.to_json(F.struct(c.cast("string").alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.cast("string").alias("x")))) - 6), F.lit("null"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.coalesce(views, F.array().cast("array<string>"))), quoted), ","), F.lit("]"))
    text = F.concat(F.lit('{"anchor_index":'), F.coalesce(anchor.cast("string"), F.lit("null")), F.lit(',"media_realpath":'), quoted(media), F.lit(',"profile":'), quoted(profile), F.lit(',"unit_level":'), quoted(level), F.lit(',"views":'), listed, F.lit("}"))
    return F.sha2(text, 256)
