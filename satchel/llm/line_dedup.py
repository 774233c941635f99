"""Later copies of repeated line runs are deleted.

Lines are letters of a long text (one per document, matches never cross
documents). Distributed prefix doubling sorts the suffixes that begin at each
line to the depth a decision needs: a rank over one line, joined with the rank
one line on, gives the rank over two lines, then four, eight. Suffixes whose
prefix occurs once leave the work at once. All suffixes that share a prefix of
``n`` lines are one interval of the suffix array with a longest common prefix
of at least ``n``; it is named by the ranks of its first and last power-of-two
lines, so no array has to be gathered anywhere.

A run counts when it is ``min_chars`` characters long (line ends included) or
``depth`` lines long. Every interval of a shortest such run has a first copy
(smallest id, then line); the lines of all others go. A longer repeated run is
the union of the shortest ones that begin or end in it, so maximal repeated
runs go whole, in all copies but the first.

Defined results: a null text stays null with no lines; an empty text is one
empty line and stays; copies inside one document count as later ones, also
where they overlap. A document is a row's id and text together: rows that
share an id, or have none, are documents of their own with their own lines
(of one id, in the order of a hash of their texts); rows that repeat id and
text are one document, counted once and deleted alike. Columns other than id
and text are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm.columns import unused
from satchel.operators.ranking import with_position
from satchel.session import staged

MIN_CHARS = 200
DEPTH = 8


def _document(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text"))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line, letter, chars) of every line; the letter is a 64-bit hash of
    the line, chars its length with the line end."""
    docs = docs.select(_document(docs, id_col, text_col).alias("doc"), docs[text_col].alias("text"))
    twice = staged(docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "repeated-rows")
    if not twice.isEmpty():
        # Copies of a row meet before their texts are cut into lines.
        once = docs.join(twice, "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text"))
        docs = docs.join(twice, "doc", "left_anti").unionByName(once)
    one = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return one.select("doc", F.col("line").cast("long").alias("line"), F.xxhash64("content").alias("letter"), (F.length("content") + 1).cast("long").alias("chars"))


def _ranked(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rank of each key that occurs more than once, in the order of the keys."""
    often = pairs.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)
    return with_position(often, [F.col(k) for k in keys], name)


def suffix_ranks(lines: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc, line, chars, r1, r2, r4...): the rank of the suffix at a line by
    its first 1, 2, 4 ... lines up to ``depth``; null where that prefix occurs
    once or leaves the document. Lines that occur once are left out."""
    ranks = staged(lines.join(_ranked(lines, ["letter"], "r1"), "letter").select("doc", "line", "chars", "r1"), "ranks")
    h = 1
    while 2 * h <= depth:
        near, far, name = f"r{h}", f"_far{h}", f"r{2 * h}"
        # Lines that occur once are gone, so the line h on is found by its number.
        there = Window.partitionBy("doc").orderBy("line").rangeBetween(h, h)
        pairs = ranks.withColumn(far, F.first(near).over(there))
        both = pairs.where(F.col(near).isNotNull() & F.col(far).isNotNull())
        order = _ranked(both.select(near, far), [near, far], name)
        ranks = staged(pairs.join(order, [near, far], "left").drop(far), f"ranks{2 * h}")
        h *= 2
    return ranks


def _power(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def repeated_runs(ranks: DataFrame, min_chars: int = MIN_CHARS, depth: int = DEPTH) -> DataFrame:
    """(doc, line, n_lines) of the shortest runs that count and are later
    copies of an earlier one."""
    order = Window.partitionBy("doc").orderBy("line")

    def there(name: str, k: int) -> Column:
        return F.first(name).over(order.rangeBetween(k, k)) if k else F.col(name)

    # What a row needs from its neighbours, by their line numbers.
    near = {f"chars{k}": there("chars", k) for k in range(1 - depth, depth)}
    for n in range(1, depth + 1):
        p = _power(n)
        near |= {f"r{p}_{k}": there(f"r{p}", k) for k in (0, n - p, 1 - n, 1 - p)}
    seen = ranks.select("doc", "line", *[c.alias(name) for name, c in near.items()])

    def shortest(sign: int) -> Column:
        """Lines of the shortest run that counts, beginning or ending here."""
        total = F.col("chars0")
        out = F.when(total >= min_chars if depth > 1 else total.isNotNull(), 1)
        for k in range(1, depth):
            total = total + F.col(f"chars{sign * k}")  # null beyond a line that occurs once
            out = out.when(total >= min_chars if k + 1 < depth else total.isNotNull(), k + 1)
        return out

    def interval(n: int, at: int) -> Column:
        """The run of ``n`` lines beginning ``at`` lines on, and its interval."""
        p = _power(n)
        return F.struct(
            (F.col("line") + at).alias("line"), F.lit(n).alias("n_lines"),
            F.col(f"r{p}_{at}").alias("head"), F.col(f"r{p}_{at + n - p}").alias("tail"),
        )

    sized = seen.withColumn("_begin", shortest(1)).withColumn("_end", shortest(-1))
    begin, end = F.lit(None), F.lit(None)
    for n in range(1, depth + 1):
        begin = F.when(F.col("_begin") == n, interval(n, 0)).otherwise(begin)
        end = F.when(F.col("_end") == n, interval(n, 1 - n)).otherwise(end)
    runs = sized.select("doc", F.inline(F.array_distinct(F.array(begin, end))))
    runs = runs.where("head is not null and tail is not null").distinct()
    key = ["n_lines", "head", "tail"]
    firsts = runs.groupBy(*key).agg(F.min(F.struct("doc", "line")).alias("_first"), F.count("*").alias("_n"))
    later = runs.join(firsts.where("_n > 1"), key).where(F.struct("doc", "line") != F.col("_first"))
    return later.select("doc", "line", "n_lines")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, depth: int = DEPTH
) -> DataFrame:
    """``docs`` with the lines of later copies cut from the text, and two more
    columns: ``n_lines`` and ``n_deleted`` (these names replace columns that
    bear them already). ``depth`` is a power of two."""
    ranks = suffix_ranks(lines_of(docs, id_col, text_col), depth)
    runs = repeated_runs(ranks, min_chars, depth)
    docs = docs.drop("n_lines", "n_deleted")
    doc, gone_lines, split = unused(docs, "_doc", "_gone", "_lines")
    gone = runs.select(F.col("doc").alias(doc), F.explode(F.sequence("line", F.col("line") + F.col("n_lines") - 1)).alias("line"))
    gone = staged(gone.groupBy(doc).agg(F.collect_set(F.col("line").cast("int")).alias(gone_lines)), "lines-gone")
    # By shuffle at every size: few deletions or many, texts move once.
    both = docs.join(gone.hint("merge"), _document(docs, id_col, text_col) == gone[doc], "left")
    every = F.sequence(F.lit(0), F.size(split) - 1)
    kept = F.transform(F.array_except(every, F.col(gone_lines)), lambda i: F.element_at(F.col(split), i + 1))
    whole, empty = F.col(text_col).isNull(), F.lit(0).cast("long")
    return (
        both.withColumn(split, F.split(F.col(text_col), "\n"))
        .withColumn("n_lines", F.when(whole, empty).otherwise(F.size(split).cast("long")))
        .withColumn("n_deleted", F.when(whole | F.col(gone_lines).isNull(), empty).otherwise(F.size(gone_lines).cast("long")))
        .withColumn(text_col, F.when(F.col(gone_lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .drop(doc, gone_lines, split)
    )
