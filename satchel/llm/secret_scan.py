"""Secrets in whole texts, found through a trigram index.

Every block of texts that a task holds gets an inverted index of its own: from
each trigram that any rule asks for to the sorted numbers of the texts that
hold it, A-Z lowered. A rule's regular expression gives a Boolean query over
trigrams that every match must satisfy; the query is answered by intersecting
and uniting posting lists, and only the texts that are left are searched with
the expression itself. A rule without any mandatory trigram (a run of hex
digits) has the query that is always true and scans all texts. Nothing is
shuffled, and a lost task is one block of rows to read again.

Defined results: a null text is an empty one and holds nothing; each row is
answered for itself, so rows that repeat an id, or have none, stay as many;
other columns of the table are not looked at. Positions count code points.
Matches of a rule do not overlap, the leftmost one counts; one whose value is
too short is dropped after it has taken its place. Texts are searched whole.
The rules' expressions never look twice at a stretch that failed, so time
grows in proportion to the text, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser as regex_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from satchel.llm.words import _LOWER, blocks, text_bytes


class Rule(NamedTuple):
    """A kind of secret: ``group`` of each match has ``least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The three kinds that every scan reports, in this order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("map_service", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("login", r"(?:https?|ftp|mysql|postgres|postgresql|mongodb|redis|amqp)://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/@]+)@", 1, 4),
)
RULES = BASE_RULES + MORE_RULES

# A Boolean query: ALWAYS, a trigram, ("and", queries) or ("or", queries).
ALWAYS = ("and", frozenset())
MANY = 64  # strings followed at once; beyond that only their ends are
CLASS = 8  # members of a character class that are told apart


class _Known(NamedTuple):
    """What is known of all strings a piece of an expression matches: the set
    itself (``exact``) or their beginnings, ends and a query they satisfy."""

    exact: frozenset | None
    starts: frozenset
    ends: frozenset
    query: tuple


_EMPTY = _Known(frozenset({b""}), frozenset({b""}), frozenset({b""}), ALWAYS)
_ANY = _Known(None, frozenset({b""}), frozenset({b""}), ALWAYS)


def _both(*queries: tuple) -> tuple:
    parts = frozenset().union(*(q[1] if q[0] == "and" else {q} for q in queries))
    return next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _either(queries: Iterable[tuple]) -> tuple:
    parts = frozenset(queries)
    if ALWAYS in parts:
        return ALWAYS
    return next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _grams(strings: frozenset) -> tuple:
    """One of the strings is there: all its trigrams are."""
    return _either(_both(*(("gram", s[i : i + 3]) for i in range(len(s) - 2))) for s in strings)


def _exactly(strings: frozenset) -> _Known:
    if len(strings) <= MANY:
        return _Known(strings, strings, strings, ALWAYS)
    return _Known(None, frozenset(s[:2] for s in strings), frozenset(s[-2:] for s in strings), _grams(strings))


def _loose(x: _Known) -> _Known:
    return x if x.exact is None else x._replace(exact=None, query=_both(x.query, _grams(x.exact)))


def _joined(xs: frozenset, ys: frozenset) -> frozenset:
    return frozenset(x + y for x, y in product(xs, ys))


def _then(x: _Known, y: _Known) -> _Known:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MANY:
        return _exactly(_joined(x.exact, y.exact))
    query = _both(_loose(x).query, _loose(y).query)
    seam = _joined(frozenset(s[-2:] for s in x.ends), frozenset(s[:2] for s in y.starts))
    if len(seam) <= MANY:
        query = _both(query, _grams(seam))
    starts = x.starts if x.exact is None else _joined(x.exact, frozenset(s[:2] for s in y.starts))
    ends = y.ends if y.exact is None else _joined(frozenset(s[-2:] for s in x.ends), y.exact)
    return _Known(None, starts if len(starts) <= MANY else x.starts, ends if len(ends) <= MANY else y.ends, query)


def _one_of(xs: list[_Known]) -> _Known:
    if all(x.exact is not None for x in xs):
        return _exactly(frozenset().union(*(x.exact for x in xs)))
    xs = [_loose(x) for x in xs]
    return _Known(None, frozenset().union(*(x.starts for x in xs)), frozenset().union(*(x.ends for x in xs)), _either(x.query for x in xs))


def _letter(code: int) -> bytes:
    return chr(code).encode().lower()


def _known(op, value) -> _Known:
    if op is sre.LITERAL:
        return _exactly(frozenset({_letter(value)}))
    if op is sre.IN:
        codes: set[int] = set()
        for kind, what in value:
            if kind is sre.LITERAL:
                codes.add(what)
            elif kind is sre.RANGE and what[1] - what[0] < 256:
                codes.update(range(what[0], what[1] + 1))
            else:
                return _ANY
        some = frozenset(_letter(c) for c in codes)
        return _exactly(some) if len(some) <= CLASS else _ANY
    if op is sre.SUBPATTERN:
        return _sequence(value[-1])
    if op is sre.BRANCH:
        return _one_of([_sequence(x) for x in value[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        once = _sequence(inner)
        if (least, most) == (0, 1):
            return _one_of([_EMPTY, once])
        start = reduce(_then, [once] * min(least, 3), _EMPTY)
        return start if least == most <= 3 else _then(start, _ANY)
    if op is sre.AT:
        return _EMPTY
    return _ANY


def _sequence(parsed) -> _Known:
    return reduce(_then, (_known(op, value) for op, value in parsed), _EMPTY)


def trigram_query(pattern: str) -> tuple:
    """A Boolean query over trigrams (A-Z lowered, UTF-8) that holds for every
    text in which ``pattern`` matches; ALWAYS if there is none."""
    return _loose(_sequence(regex_parser.parse(pattern, re.ASCII))).query


def query_grams(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "gram" else set().union(*(query_grams(q) for q in query[1]))


STEP = 1 << 20  # bytes looked at together while an index is made


class Postings:
    """Inverted index of a run of texts over the trigrams that are ``wanted``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        asked = np.zeros(1 << 24, dtype=bool)
        asked[wanted] = True
        found = [np.zeros(0, dtype=np.int64)]
        for at in range(0, max(len(data) - 2, 0), STEP):
            low = _LOWER[data[at : at + STEP + 2]].astype(np.uint32)
            codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
            hits = np.flatnonzero(asked[codes])
            doc = np.searchsorted(offsets, hits + at, "right") - 1
            whole = hits + at + 2 < offsets[doc + 1]
            found.append(np.unique((codes[hits[whole]].astype(np.int64) << 32) | doc[whole]))
        pairs = np.unique(np.concatenate(found))
        grams, docs = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(grams)) + 1
        self.count = len(offsets) - 1
        self.lists = {int(g[0]): d for g, d in zip(np.split(grams, cuts), np.split(docs, cuts)) if len(g)}

    def answer(self, query: tuple) -> np.ndarray:
        """Numbers of the texts that satisfy the query, in order."""
        kind, of = query
        if kind == "gram":
            return self.lists.get(int.from_bytes(of, "big"), np.zeros(0, dtype=np.int64))
        if query == ALWAYS:
            return np.arange(self.count)
        parts = sorted((self.answer(q) for q in of), key=len)
        together = np.union1d if kind == "or" else lambda a, b: np.intersect1d(a, b, assume_unique=True)
        return reduce(together, parts)


def _scanner(rules: tuple[Rule, ...], out: pa.Schema):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        compiled = [r.compiled for r in rules]
        wanted = sorted(set().union(*map(query_grams, queries)))
        wanted = np.array([int.from_bytes(g, "big") for g in wanted], dtype=np.int64)
        for block in blocks(batches, "text"):
            texts = block.column("text")
            index = Postings(*text_bytes(texts), wanted)
            texts = pc.fill_null(texts, "").to_pylist()
            found: list[list] = [[] for _ in texts]
            for k, (rule, query) in enumerate(zip(rules, queries)):
                for d in index.answer(query).tolist():
                    for m in compiled[k].finditer(texts[d]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[d].append((m.start(), k, m.end()))
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(spans, out.field("found").type)], schema=out)

    return work


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, found) for each row: ``found`` lists kind, start and end of every
    match, by start and then in the order of the rules."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([rows.schema["id"], T.StructField("found", T.ArrayType(span))])
    return rows.mapInArrow(_scanner(tuple(rules), to_arrow_schema(schema)), schema)
