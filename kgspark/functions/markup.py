"""HTML as tokens: tags, texts, attributes and character references.

One regular expression goes through a page from left to right and takes, where it
stands, a comment, an element of raw text, a tag with its quoted values, or text.
So a ``>`` in a quoted value ends no tag, ``<!--`` in a script opens no comment, and
a tag in a comment is none.  All loops are possessive: their cost is linear and
their depth fixed, however long a page is.
"""

from __future__ import annotations

import codecs
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is no text of the page and holds no tags.
RAW = ("script", "style", "noscript", "iframe", "noembed", "noframes")

# What follows a tag's name: values count as quoted only after an equals sign.  A
# quote that is never closed is a character like others.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+>"""
_TAG = rf"</?+[A-Za-z]{_REST}"
_COMMENT = r"<!--(?:-?+>|.*?(?:--!?+>|\z))"
_DECLARATION = r"<![A-Za-z][^>]*+>"
_BOGUS = r"<(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\z)"
# A tag that the page's end cuts off; tried after whole ones.
_UNFINISHED = r"</?+[A-Za-z].*+"
_TEXT = r"(?:[^<]++|<(?![A-Za-z!?/]))++"


def _raw_element(group: int) -> str:
    """An element of raw text up to the end tag of its own name, or to the end of the page."""
    return rf"<(?i:({'|'.join(RAW)}))(?=[\s/>]){_REST}.*?(?:</(?i:\{group})(?=[\s/>])[^>]*+>|\z)"


def clean(html: Column) -> Column:
    """Without comments, elements of raw text and a tag that the page's end cuts off."""
    return F.regexp_replace(html, rf"(?s)(?:{_COMMENT}|(?!{_DECLARATION}){_BOGUS}|{_raw_element(1)})|({_DECLARATION}|{_TAG}|{_TEXT})|{_UNFINISHED}", "$2")


def cut(html: Column) -> Column:
    """The tags and texts of a page in order, and its declaration, which has a place but no text."""
    return F.regexp_extract_all(clean(html), F.lit(rf"(?s){_DECLARATION}|{_TAG}|{_TEXT}"), F.lit(0))


def title(html: Column) -> Column:
    """The source of the first title, in which no tag counts but its end; empty if there is none."""
    other = rf"{_COMMENT}|{_BOGUS}|{_raw_element(1)}|(?!<(?i:title)[\s/>])(?:{_TAG}|{_TEXT})"
    return F.regexp_extract(html, rf"(?s)^(?:{other})*+<(?i:title)(?=[\s/>]){_REST}(.*?)(?:</(?i:title)[\s/>]|\z)", 2)


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, as written: in either quotes or none; the first of two; empty if there is none."""
    own = rf"(?i:{name})(?=[\s=/>]|\z)"
    value = r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))?+"""
    found = F.regexp_extract(attrs, rf"""(?s)^(?:[\s/]++|(?!{own})[^\s/>=]++{value}|=)*+{own}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)""", 1)
    return F.when(F.left(found, F.lit(1)).isin('"', "'"), F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found)


def _references() -> dict[str, str]:
    """Characters by reference, without the ``&``: names as the standard's table has
    them, frequent ones first, then the numbers that stand for Windows-1252."""
    first = ("nbsp;", "amp;", "quot;", "lt;", "gt;", "apos;", "mdash;", "ndash;", "rsquo;", "lsquo;", "ldquo;", "rdquo;", "hellip;", "copy;", "middot;", "bull;")
    found = {name: html5[name] for name in (*first, *html5)}
    for code in range(0x80, 0xA0):
        char = codecs.decode(bytes([code]), "cp1252", "ignore")
        if char:
            found[f"#{code}"] = char
    # A blank that doesn't break is white space like any other here.
    return {name: " " if char == "\xa0" else char for name, char in found.items()}


def _table() -> Column:
    # Its arguments are constant, so the plan holds one map, made once.
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in _references().items())), F.lit("\x02"), F.lit("\x01"))


# Names that need no semicolon, longer ones first, as they are matched in this order.
_BARE = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n)))


def _character(code: Column) -> Column:
    """The character of a number; those that none has are U+FFFD."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    point = F.when(valid, code).otherwise(0xFFFD)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def unescape(text: Column, in_attribute: bool = False) -> Column:
    """With character references as characters, each once: all names, decimal and
    hexadecimal numbers.

    Old names need no semicolon; in an attribute they do when a letter, a digit or
    an equals sign follows, so that ``?a=1&copy=2`` stays.  U+00A0 by reference
    is a blank.
    """
    bare = rf"&(?:{_BARE})" + (r"(?![=A-Za-z0-9])" if in_attribute else "")
    pieces = F.regexp_extract_all(text, F.lit(rf"&#[xX][0-9A-Fa-f]++;?+|&#[0-9]++;?+|&[A-Za-z][A-Za-z0-9]*+;|{bare}|[^&]++|&"), F.lit(0))
    table = _table()

    def decode(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#[xX]?0*+([0-9A-Fa-f]*+)", 1)
        # More digits than any character has are none.
        hexadecimal = F.lower(F.substring(piece, 3, 1)) == "x"
        number = F.when(F.length(digits) > 8, 0).when(hexadecimal, F.conv(digits, 16, 10).try_cast("long")).otherwise(digits.try_cast("long"))
        number = F.coalesce(number, F.lit(0))
        named = F.element_at(table, F.substr(piece, F.lit(2)))
        if not in_attribute:
            prefix = F.regexp_extract(piece, rf"^&({_BARE})", 1)
            named = F.coalesce(named, F.when(prefix != "", F.concat(F.element_at(table, prefix), F.substr(piece, F.length(prefix) + 2))))
        numbered = F.coalesce(F.element_at(table, F.concat(F.lit("#"), number.cast("string"))), F.when(number == 0xA0, " ").otherwise(_character(number)))
        return F.when(~F.startswith(piece, F.lit("&")) | (piece == "&"), piece).when(F.startswith(piece, F.lit("&#")), numbered).otherwise(F.coalesce(named, piece))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decode), "")).otherwise(text)
