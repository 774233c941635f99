"""Tokens, line-wise chunking and highlighting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits, in text order."""
    return F.array_remove(F.split(F.lower(text), TOKEN_BREAK), "")


def query_terms(text: Column) -> Column:
    """Distinct tokens of a question; all of them must occur in a match."""
    return F.array_distinct(tokens(text))


def chunk_text(text: Column, max_chars: int) -> Column:
    """Split text into chunks of about ``max_chars`` characters on line ends.

    Text within the limit stays whole. Longer text is packed line by line,
    each line closed by a newline; a line beyond the limit is cut into
    ``max_chars`` pieces that stand alone and its rest opens the next chunk.
    """
    limit = F.lit(int(max_chars))
    no_chunks = F.array().cast("array<string>")
    start = F.struct(no_chunks.alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def with_open(state: Column) -> Column:
        return F.when(state["size"] > 0, F.array_append(state["done"], state["open"])).otherwise(state["done"])

    def add_line(state: Column, line: Column) -> Column:
        width = F.char_length(line)
        cuts = F.floor((width - 1) / limit).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.substring(line, i * limit + 1, limit))
        rest = F.substring(line, cuts * limit + 1, limit)
        cut_line = F.struct(
            F.concat(with_open(state), pieces).alias("done"),
            F.concat(rest, F.lit("\n")).alias("open"),
            (F.char_length(rest) + 1).alias("size"),
        )
        new_chunk = F.struct(
            with_open(state).alias("done"),
            F.concat(line, F.lit("\n")).alias("open"),
            (width + 1).alias("size"),
        )
        same_chunk = F.struct(
            state["done"].alias("done"),
            F.concat(state["open"], line, F.lit("\n")).alias("open"),
            (state["size"] + width + 1).alias("size"),
        )
        return (
            F.when(width > limit, cut_line)
            .when((state["size"] > 0) & (state["size"] + width + 1 > limit), new_chunk)
            .otherwise(same_chunk)
        )

    packed = F.aggregate(F.split(text, "\n", -1), start, add_line, with_open)
    return F.when(F.char_length(text) <= limit, F.array(text)).otherwise(packed)


def preview(content: Column, size: int = 200) -> Column:
    """Leading characters shown in listings."""
    return F.substring(content, 1, size)


def highlight(content: Column, query: Column) -> Column:
    """Wrap every occurrence of a query word of two or more letters in a mark."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.char_length(w) > 1)
    escaped = F.transform(words, lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    pattern = F.concat(F.lit("(?iu)("), F.array_join(escaped, "|"), F.lit(")"))
    return F.when(F.size(words) > 0, F.regexp_replace(content, pattern, F.lit("<mark>$1</mark>"))).otherwise(content)


def three_decimals(x: Column) -> Column:
    """A double as text with three decimals, rounded from its exact binary
    value, exact halves to even. The JVM's own format rounds the shortest
    decimal form instead, which differs on values such as 0.0375."""
    twice = F.rint(x * 2000)
    at_half = (x * 2000 == twice) & (twice % 2 != 0)
    # x*2000 - twice without rounding: the factors are powers of two and each
    # difference is of numbers close to one another.
    rest = x * 2048 - twice - x * 32 - x * 16
    below, above = (twice - 1) / 2, (twice + 1) / 2
    to_even = F.when(below % 2 == 0, below).otherwise(above)
    thousandths = (
        F.when(~at_half, F.rint(x * 1000)).when(rest > 0, above).when(rest < 0, below).otherwise(to_even)
    )
    return F.format_string("%.3f", thousandths / 1000)
