"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.sources.tables import load, work_dir
from kgspark.sources.tables import store as materialize

__all__ = ["BROADCAST_LIMIT", "SPACES", "SPACE_RUN", "fits_broadcast", "join_sized", "let", "load", "materialize", "slices", "split_terms", "words_of", "work_dir"]

#: White space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Largest table, in bytes, that may be broadcast.  Larger ones are shuffled.
BROADCAST_LIMIT = 32 << 20


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether a materialised table is below the limit; counts its rows."""
    return df.count() * row_bytes <= limit


def join_sized(big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Join that broadcasts ``small`` if its counted size allows, else shuffles."""
    return big.join(F.broadcast(small) if fits_broadcast(small, row_bytes, limit) else small, on, how)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so that lambdas in ``body`` don't compute it again."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows of a batch, with their texts, in parts of about ``limit`` characters."""
    values = batch[column].to_pylist()
    begin = held = 0
    for k, v in enumerate(values):
        held += len(v or "")
        if held >= limit or k == len(values) - 1:
            yield batch.slice(begin, k + 1 - begin), values[begin : k + 1]
            begin, held = k + 1, 0


def split_terms(raw: bytes, table: bytes, limit: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists from about ``limit`` bytes each.

    ``table`` maps each byte that ends a term to a space, and the others to
    what a term has for them.
    """
    begin = 0
    while begin < len(raw):
        end = begin + limit
        # Up to a byte that ends a term, so that none is cut.
        while end < len(raw) and table[raw[end]] != 32:
            end += 1
        yield raw[begin:end].translate(table).split()
        begin = end
