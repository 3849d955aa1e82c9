"""Caption and text helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing caption.
NULL_WORDS = ("", "none", "n/a", "na", "null", "nan", "unknown")
#: White space as Unicode counts it.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"


#: Small letters that full case folding writes in another way: ligatures, sharp s, the sigma at a word's end and so on.
_FOLDS = [(c, c.casefold()) for c in map(chr, range(0x110000)) if c.lower() == c != c.casefold()]
_WIDE = [c for c, _ in _FOLDS if c > "\xff"]
#: Most characters are told by one comparison with the range that the wide ones are in.
_FOLDED = "[" + "".join(c for c, _ in _FOLDS if c <= "\xff") + f"[{_WIDE[0]}-{_WIDE[-1]}&&[" + "".join(_WIDE) + "]]]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(text: Column) -> Column:
    """Without differences of case, by full case folding."""
    # letters to fold become pieces of their own, so that a text is gone through once for all of them
    known = F.create_map(*(F.lit(x) for pair in _FOLDS for x in pair))
    pieces = lambda t: F.transform(F.split(t, f"(?<={_FOLDED})|(?={_FOLDED})"), lambda x: F.when(F.length(x) == 1, F.coalesce(F.try_element_at(known, x), x)).otherwise(x))
    return bound(F.lower(text), lambda small: F.when(small.rlike(_FOLDED), F.array_join(pieces(small), "")).otherwise(small))


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends; null words and nulls are empty."""
    # folding makes no text shorter, so only short ones can be null words
    null_word = lambda one: (F.length(one) <= max(map(len, NULL_WORDS))) & folded(one).isin(*NULL_WORDS)
    return bound(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")), lambda one: F.when(null_word(one), "").otherwise(one))


def normalised(text: Column) -> Column:
    """Collapsed, without differences of case, without punctuation at the end."""
    return F.regexp_replace(folded(collapsed(text)), r"(?<![\s\.,;:!?。！？，；：…])[\s\.,;:!?。！？，；：…]++$", "")


def is_latin_caption(text: Column) -> Column:
    """Holds a Latin letter, and no CJK ideograph."""
    return bound(collapsed(text), lambda one: one.rlike("[A-Za-z]") & ~one.rlike("[㐀-䶿一-鿿豈-﫿]"))


def agreed_caption(captions: Column) -> Column:
    """The one caption of an array: the first valid one, cleaned, if all valid ones are equal when normalised; empty otherwise."""
    valid = F.filter(captions, is_latin_caption)
    return F.when(F.size(F.array_distinct(F.transform(valid, normalised))) == 1, collapsed(F.element_at(valid, 1))).otherwise("")


def first_caption(*fields: Column) -> Column:
    """The first field that is a valid caption, cleaned; empty if none is."""
    return F.coalesce(*(F.when(is_latin_caption(x), collapsed(x)) for x in fields), F.lit(""))


def interval_key(text: Column) -> Column:
    """(start, end) of "a b" or "a,b"; null for anything but two whole numbers."""
    parts = F.filter(F.split(F.regexp_replace(text, ",", " "), r"\s+"), lambda x: x != "")
    fits = (F.size(parts) == 2) & F.forall(parts, lambda x: x.rlike(r"^[+-]?[0-9]{1,18}$"))
    return F.when(fits, F.struct(F.element_at(parts, 1).try_cast("long").alias("start"), F.element_at(parts, 2).try_cast("long").alias("end")))


def pointer_parts(pointer: Column) -> Column:
    """The names of a JSON pointer, ~1 and ~0 read as / and ~; null where it doesn't begin with a slash."""
    names = F.transform(F.split(F.substring(pointer, 2, 2**31 - 1), "/"), lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(F.startswith(pointer, F.lit("/")), names)


def unfenced(text: Column) -> Column:
    """Trimmed text without the first and last line of a code fence around it."""
    one = F.regexp_replace(text, r"^\s+|\s+$", "")
    lines = F.split(one, "\n")
    inner = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n"), r"^\s+|\s+$", "")
    return F.when(one.rlike("(?s)^```.*```$") & (F.size(lines) >= 3), inner).otherwise(one)


def slug(text: Column) -> Column:
    """Letters, digits, dots, underscores and hyphens; runs of anything else as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")


def portable_id(text: Column) -> Column:
    """The slug's first 96 characters, a hyphen, and 12 hex digits of the whole text's SHA-256."""
    return F.concat(F.regexp_replace(F.substring(slug(text), 1, 96), r"[-.]+$", ""), F.lit("-"), F.substring(F.sha2(text, 256), 1, 12))


def last_of(items: Column, k: int) -> Column:
    """The last k items of an array."""
    return F.slice(items, F.greatest(F.size(items) - k + 1, F.lit(1)), k)


def numbered(items: Column, visible: int = 8) -> Column:
    """The last items as numbered lines, told when earlier ones are left out."""
    shown = last_of(items, visible)
    lines = F.array_join(F.transform(shown, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.when(F.size(items) == 0, "[none]").otherwise(F.concat(F.when(F.size(items) > visible, "[earlier steps omitted]\n").otherwise(""), lines))


def word_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


# Words that tell nothing of a task, and forms that no ending gives.
STOP_WORDS = ("a", "an", "and", "at", "by", "do", "for", "from", "in", "into", "of", "on", "the", "to", "with", "vr", "master", "slave", "mode")
FORMS = {"boxes": "box", "folding": "fold", "lemonade": "lemon", "making": "make", "packaging": "package", "scallions": "scallion"}


def caption_forms(text: Column) -> Column:
    """Distinct words of a caption but stop words, each with the forms that its ending allows."""
    words = F.filter(word_tokens(normalised(F.replace(F.replace(text, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))), lambda w: ~w.isin(*STOP_WORDS))
    known = F.create_map(*(F.lit(x) for pair in FORMS.items() for x in pair))
    cut = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    n = F.length
    ending = lambda w: F.when((n(w) > 4) & F.endswith(w, F.lit("ies")), F.concat(cut(w, 3), F.lit("y"))).when((n(w) > 4) & F.endswith(w, F.lit("es")), cut(w, 2)).when((n(w) > 3) & F.endswith(w, F.lit("s")), cut(w, 1))
    doing = lambda w: F.when((n(w) > 5) & F.endswith(w, F.lit("ing")), cut(w, 3))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(words, lambda w: F.array(w, F.try_element_at(known, w), ending(w), doing(w))))))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
