"""Text expressions: Column to Column, without UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.functions import vocabulary as V

#: All Unicode white space.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    # Between printable characters of ASCII there is nothing to take off.
    printable = lambda c: c.between("!", "~")
    return F.when(printable(F.left(text, F.lit(1))) & printable(F.right(text, F.lit(1))), text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def sentences(text: Column) -> Column:
    """Split after . ! ? followed by white space; blank sentences are dropped."""
    return F.filter(F.split(collapse(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def token_estimate(text: Column) -> Column:
    """Words times 1.3, rounded down; 0 for empty text."""
    return F.floor(F.size(words(F.coalesce(text, F.lit("")))) * F.lit(1.3)).cast("int")


def is_transition(sentence: Column) -> Column:
    return contains_any(F.lower(sentence), V.TRANSITIONS)


def block_type(text: Column, original: Column) -> Column:
    """Code and lists keep their type; else the first list of phrases that fits."""
    low = F.lower(text)
    return F.when(original.isin("code", "list"), original).when(contains_any(low, V.DEFINITION_PHRASES), "definition").when(contains_any(low, V.EXAMPLE_PHRASES), "example").otherwise("explanation")


def is_generic(name: Column) -> Column:
    low = strip(F.lower(name))
    return low.isin(*V.STOP_CONCEPTS) | (F.length(low) < 3)


def name_key(name: Column) -> Column:
    """Lower case, no punctuation, hyphens as blanks, simple plurals cut off."""
    low = F.lower(F.coalesce(name, F.lit("")))
    plain = F.regexp_replace(low, r"(?U)[^\w\s-]", "")
    singular = lambda w: F.when(F.endswith(w, F.lit("es")) & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 2)).when(F.endswith(w, F.lit("s")) & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    whole = F.array_join(F.transform(words(F.replace(plain, F.lit("-"), F.lit(" "))), singular), " ")
    # A single word of letters, which most names are, has nothing to take out or split.
    return F.when(F.rlike(low, F.lit(r"^\p{L}+\z")), singular(low)).otherwise(whole)


def short_hash(*parts: Column) -> Column:
    """Twelve hex digits of the md5 of the parts joined by |."""
    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)


def is_error_page(title: Column, content: Column) -> Column:
    """Signs of an error or blocked page in the title or the first 2000 characters."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return contains_any(low(title), V.ERROR_TITLES) | contains_any(F.left(low(content), F.lit(2000)), V.ERROR_CONTENTS)
