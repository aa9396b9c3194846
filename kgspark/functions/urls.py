"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.functions import vocabulary as V
from kgspark.functions.text import strip


def part(url: Column, name: str) -> Column:
    """scheme, netloc, path, query or fragment of a URL; empty if it has none."""
    group = {"scheme": 2, "netloc": 4, "path": 5, "query": 7, "fragment": 9}[name]
    return F.regexp_extract(url, r"(?s)^(([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$", group)


def domain(url: Column) -> Column:
    """Host with user and port, as written."""
    return part(url, "netloc")


def is_valid(url: Column) -> Column:
    return (part(url, "scheme") != "") & (part(url, "netloc") != "")


def same_domain(a: Column, b: Column) -> Column:
    return domain(a) == domain(b)


def document_id(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


def without_dots(path: Column) -> Column:
    """Path without . and .. segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    step = lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def normalize(url: Column, base: Column | None = None) -> Column:
    """Absolute URL, resolved against ``base`` if given, without fragment."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    if base is None:
        return plain
    scheme, netloc = part(base, "scheme"), part(base, "netloc")
    root = F.concat(scheme, F.lit("://"), netloc)
    path, query = part(plain, "path"), F.regexp_extract(plain, r"(?s)(\?.*)$", 1)
    folder = F.regexp_replace(part(base, "path"), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    base_query = F.when(part(base, "query") != "", F.concat(F.lit("?"), part(base, "query"))).otherwise("")
    return (
        F.when(part(plain, "scheme") != "", plain)
        .when(F.startswith(plain, F.lit("//")), F.concat(scheme, F.lit(":"), plain))
        .when(plain == "", F.concat(root, part(base, "path"), base_query))
        .when(path == "", F.concat(root, part(base, "path"), query))
        .when(F.startswith(path, F.lit("/")), F.concat(root, without_dots(path), query))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), query))
    )


def strip_tracking(url: Column, parameters: tuple[str, ...] = V.TRACKING_PARAMETERS) -> Column:
    """Without tracking parameters, blank values and fragment; values of a key together.

    A URL without a query stays as it is, with its fragment.
    """
    split = F.transform(F.split(part(url, "query"), "&"), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"(?s)^[^=]*=", "")).otherwise("")).alias("v")))
    kept = F.filter(split, lambda p: (p["v"] != "") & ~p["k"].isin(*parameters))
    keys = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    pairs = F.flatten(F.transform(keys, lambda k: F.transform(F.filter(kept, lambda p: p["k"] == k), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"])))))
    query = F.array_join(pairs, "&")
    before = F.concat(F.when(part(url, "scheme") != "", F.concat(part(url, "scheme"), F.lit(":"))).otherwise(""), F.when(part(url, "netloc") != "", F.concat(F.lit("//"), part(url, "netloc"))).otherwise(""), part(url, "path"))
    return F.when(part(url, "query") == "", url).otherwise(F.concat(before, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def sanitize(url: Column) -> Column:
    """A URL as a user typed it: without blanks, <>, quotes, closing marks that open nowhere."""
    bare = strip(url)
    bare = F.regexp_replace(bare, r"^[<>]+|[<>]+$", "")
    bare = strip(F.regexp_replace(bare, r"""(?s)^(["'])(.*)\1$""", "$2"))
    bare = F.regexp_replace(bare, r"""(?U)['",;\s]+$""", "")
    for opening, closing in (("(", ")"), ("[", "]")):
        count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
        run = F.length(F.regexp_extract(bare, rf"(\{closing}*)$", 1))
        bare = F.left(bare, F.length(bare) - F.least(F.greatest(count(closing) - count(opening), F.lit(0)), run))
    return bare
