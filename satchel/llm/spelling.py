"""Spelling variants: words one edit apart, led to their commonest form.

Words of a sorted list are compared by dynamic programming. A row of the edit
matrix belongs to a beginning of a list word, so it is made once for the whole
range of neighbours whose common prefix (their adjacent LCPs) covers that
beginning, and only its band of three cells is kept; a range whose prefix is
already more than one edit away is skipped with all its words. Rows of many
words are made together, one letter deeper each time.

One edit leaves a long beginning or a long end of a word alone, so the list is
cut into lists that share one: a word goes to the lists of its own length and
of the length before, under its first half and under its last half (in lists
that share an end, words are read backwards). A pair is found in the one list
whose interval holds the length of its common beginning. A list of more than
``LIST_WORDS`` words is cut again, by halving its interval: its words share
more letters then. Two words that share all but one letter are the end of it,
so lists stay bounded by the alphabet, whatever the vocabulary. Bags of lists
are made by their count of letters.

Defined results: a null text has no words, a null id is the empty string in
checksums; rows that repeat an id count each for itself; other columns of the
table are not looked at. Only A-Z are lowered. Words are compared by code
points; among near words of equal count the smallest in code-point order
wins. An empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.session import staged

# Fixed value: what a word is made of.
WORD = "[A-Za-zÀ-ÿ]+"
LIST_WORDS = 50_000  # a longer list is cut again
BAG_LETTERS = 1_000_000  # letters of the lists that one group holds
QUERIES = 4_096  # words whose rows are made together
HELD = 200_000  # counts a task holds before it passes them on
_LIST = ["size", "low", "high", "head", "tail"]


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, slip: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) for words of at least ``least_length`` code points that occur
    ``least_count`` times. With ``slip``, a word of a document whose checksum
    ``slip`` divides loses one letter there first: a planted misspelling."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(WORD.replace("A-Z", ""))
        total: Counter[str] = Counter()
        for batch in batches:
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not whole:
                    continue
                words = Counter(runs.findall(whole.encode().lower().decode()))
                if slip is None:
                    slipped = words.items()
                else:
                    start, slipped = zlib.crc32(f"{key or ''}:".encode()), []
                    for word, n in words.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        slipped.append((word, n))
                for word, n in slipped:
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _lists(words: DataFrame) -> DataFrame:
    """Rows (word, n) with the lists they belong to: ``size`` is the length of
    the shorter word of a pair, ``low`` and ``high`` bound the length of what
    the two have in common at the beginning, ``head`` and ``tail`` are what
    all words of the list share. No list is left longer than LIST_WORDS."""
    size, m = F.col("size"), F.length("word")
    rows = words.withColumn("size", F.explode(F.array(m, m - 1))).withColumn("half", F.floor(size / 2).cast("int"))
    lower = F.struct(F.lit(0).alias("low"), (F.col("half") - 1).alias("high"))
    upper = F.struct(F.col("half").alias("low"), (size - 1).alias("high"))
    rows = rows.select("word", "n", "size", F.explode(F.array(lower, upper)).alias("i")).select("word", "n", "size", "i.low", "i.high").where("low <= high")

    def shared(rows: DataFrame) -> DataFrame:
        rest = size - 1 - F.col("high")
        return rows.withColumns({"head": F.substring("word", F.lit(1), F.col("low")), "tail": F.substring("word", m - rest + 1, rest)})

    rows = staged(shared(rows), "lists")
    while True:
        long = rows.where("low < high").groupBy(*_LIST).agg(F.count("*").alias("words")).where(F.col("words") > LIST_WORDS).select(*_LIST)
        long = staged(long, "long_lists")
        if long.isEmpty():
            return rows
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct((middle + 1).alias("low"), "high"))
        cut = rows.join(long, _LIST, "left_semi").select("word", "n", "size", F.explode(halves).alias("i")).select("word", "n", "size", "i.low", "i.high")
        rows = staged(rows.join(long, _LIST, "left_anti").select("word", "n", *_LIST).union(shared(cut).select("word", "n", *_LIST)), "lists")


def _pairs_of_size(letters: np.ndarray, lengths: np.ndarray, lists: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, near word) one edit apart in the same list, as numbers of
    rows; queries are the words of ``size`` letters. ``letters``: code points,
    0 after the end, one word a row; ``lists``: the number of its list."""
    width = letters.shape[1]
    order = np.lexsort((np.ascontiguousarray(letters).view(f"<U{width}").ravel(), lists))
    letters, lengths, lists = letters[order], lengths[order], lists[order]
    count = len(letters)
    differ = letters[1:] != letters[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.concatenate([[-1], np.where(lists[1:] == lists[:-1], lcp, -1)])
    # Where ranges of words with the same first d letters begin.
    begins = [np.flatnonzero(lcp < d) for d in range(width + 1)]
    ends = [np.append(b[1:], count) for b in begins]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    queries = np.flatnonzero(lengths == size)
    for some in (queries[i : i + QUERIES] for i in range(0, len(queries), QUERIES)):
        at = np.searchsorted(begins[0], some, "right") - 1
        query, start, end = some, begins[0][at], ends[0][at]
        more = end - start > 1
        query, start, end = query[more], start[more], end[more]
        # The band: edits to the query's first d - 1, d, d + 1 letters.
        band = np.tile(np.array([2, 0, 1], dtype=np.int8), (len(query), 1))
        for d in range(width):
            first = np.searchsorted(begins[d + 1], start)
            ways = np.searchsorted(begins[d + 1], end) - first
            which = np.repeat(np.arange(len(query)), ways)
            child = np.arange(len(which)) - np.repeat(np.cumsum(ways) - ways, ways) + first[which]
            query, band = query[which], band[which]
            start, end = begins[d + 1][child], ends[d + 1][child]
            letter = letters[start, d]
            asked = letters[query]
            none = np.full(len(query), 2, dtype=np.int8)
            before = np.minimum(band[:, 0] + (letter != asked[:, d - 1]), band[:, 1] + 1) if d else band[:, 1] + 1
            here = np.minimum(np.minimum(band[:, 1] + (letter != asked[:, d]), band[:, 2] + 1), before + 1) if d < size else none
            after = np.minimum(band[:, 2] + (letter != asked[:, d + 1]), here + 1) if d + 1 < size else none
            keep = (np.minimum(np.minimum(before, here), after) <= 1) & (letter != 0)
            query, start, end = query[keep], start[keep], end[keep]
            band = np.stack([before, here, after], 1)[keep].astype(np.int8)
            if d + 1 == size:
                near = (band[:, 1] == 1) & (lengths[start] == size)
                out.append((query[near], start[near]))
            elif d == size:
                near = band[:, 0] == 1
                out.append((query[near], start[near]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return order[np.concatenate([x for x, _ in out])], order[np.concatenate([y for _, y in out])]


def _near_in_bag(bag: pd.DataFrame) -> pd.DataFrame:
    """For each word of the lists in a bag: how many near words it has there,
    and the commonest of them."""
    done = []
    for size, part in bag.groupby("size"):
        size, width = int(size), int(size) + 1
        words = part["word"].to_numpy(dtype=f"<U{width}")
        forward = np.ascontiguousarray(words).view(np.uint32).reshape(-1, width)
        lengths = np.char.str_len(words)
        low, high, n = (part[c].to_numpy() for c in ("low", "high", "n"))
        lists = part.groupby(_LIST, sort=False).ngroup().to_numpy()
        # Lists that share an end rather than a beginning are read backwards.
        back = low < size - 1 - high
        place = np.arange(width)
        turned = np.where(place < lengths[:, None], lengths[:, None] - 1 - place, place)
        letters = np.where(back[:, None], np.take_along_axis(forward, turned, 1), forward)
        query, near = _pairs_of_size(letters, lengths, lists, size)
        differ = forward[query, :size] != forward[near, :size]
        common = np.minimum(np.where(differ.any(1), differ.argmax(1), size), size - 1)
        own = (low[query] <= common) & (common <= high[query])
        query, near = query[own], near[own]
        longer = lengths[near] > size
        word, other = np.concatenate([query, near[longer]]), np.concatenate([near, query[longer]])
        if not len(word):
            continue
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.argsort(words)] = np.arange(len(words))
        # A word stands in several lists: its rows are told apart by the text.
        _, same = np.unique(words, return_inverse=True)
        order = np.lexsort((rank[other], -n[other], same[word]))
        word, other = word[order], other[order]
        first = np.flatnonzero(np.append(True, np.diff(same[word]) != 0))
        counts = np.diff(np.append(first, len(word)))
        done.append(pd.DataFrame({"word": words[word[first]], "n_near": counts, "near": words[other[first]], "near_n": n[other[first]]}))
    if not done:
        return pd.DataFrame({"word": [], "n_near": np.zeros(0, "int64"), "near": [], "near_n": np.zeros(0, "int64")})
    return pd.concat(done)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) for the words of (word, n) that have near
    ones: how many, the commonest one and its count."""
    rows = _lists(words)
    letters = rows.agg(F.sum(F.length("word") + 16)).first()[0] or 0
    bags = int(letters // BAG_LETTERS + 1)
    bag = F.pmod(F.xxhash64(*_LIST), F.lit(bags))
    found = rows.groupBy(bag.alias("bag")).applyInPandas(
        lambda pdf: _near_in_bag(pdf), "word string, n_near long, near string, near_n long"
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of (word, n): its
    commonest near word where that occurs ``times`` as often at least, and
    where the forms lead in the end. Counts grow along the way, so there are
    no rings and the ways are short; each round doubles the steps taken."""
    words = staged(words, "words")
    common = F.coalesce(F.col("near_n") >= times * F.col("n"), F.lit(False))
    formed = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(common, F.col("near")).alias("form"), F.when(common, F.col("near_n")).alias("form_n"),
    )
    formed = staged(formed, "forms")
    ways = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = staged(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        if ways.where("moved").isEmpty():
            break
        ways = ways.drop("moved")
    return formed.join(ways.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
