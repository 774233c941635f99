"""Repair of conversations: the cheapest edits that give a regular exchange.

A conversation's rows stand in order of turn, null turns first; rows of one
turn by role, then text, in code-point order. A row's first fault counts: it
is blank, it repeats a role and text seen earlier in the conversation, or it
is cut off (its last black character ends no sentence). Edits keep a row,
give it another role, delete it (blank and repeated rows must go) or insert an
empty one, until the first letters of the roles read ``(s?(ua)+)?``.

Of all ways the cheapest is taken, of those the one whose audit (the letters
D, I, K, R of its edits in order) is the least. Both wishes are one integer:
the cost stands in its high digits, below it every edit has a digit at the
place that it takes in the audit, from the left, and places behind the end are
0, so that a shorter audit comes before its continuations. The rows are then a
directed graph (state of the exchange before and after each row), an edit adds
cost and digit to the weight of a way, and the least integer at the end
decides everything; repaired turns follow from its digits alone. Keeping one
weight for each state is enough: of two ways to the same state over the same
rows with the same cost, neither audit begins with the other.

Conversations of up to ``SHORT_ROWS`` rows and ``SHORT_BYTES`` bytes are
streamed one after another from sorted partitions. Longer ones are put in order
by a range shuffle, equal rows merged before; pieces of ``PIECE_ROWS`` rows get
a table of the least weights from each state to each, tables are joined in
rounds, and only the digest of the repaired text is a single run over its rows
in order, as a digest must be, in bounded memory. Both ways give the same rows.

Defined results: rows without a conversation id are one conversation. A null
role or text is one space (a role that none of the letters s, u, a begins can
not be kept, nor can an empty role). ``gaps`` counts the turns missing between
the first and the last, null turns aside. A row marked as absent only tells
that its conversation exists; one without any other row has zeros, an empty
audit and the digest of the empty string. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from satchel.session import staged

# White space, and what ends a sentence.
SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"

SHORT_ROWS, SHORT_BYTES = 4_096, 8 << 20
PIECE_ROWS = 512
FAN = 5  # tables of 2 ** FAN neighbours are joined in a round
PARTITION_BITS = 33  # of monotonically_increasing_id

START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_FROM = {"s": {START}, "u": {START, SYSTEM, ASSISTANT}, "a": {USER}}
_NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # the turn that an edit makes up
_DONE = (START, ASSISTANT)
_NAMES = {"u": "user", "a": "assistant"}
_ORDERLY = {"su", "ua", "au"}
# Digits of the audit letters, in ASCII order.
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_TO_DIGITS, _TO_LETTERS = str.maketrans("DIKR", "1234"), str.maketrans("1234", "DIKR")


class Costs(NamedTuple):
    keep: int = 0
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3  # more for a row cut off that stays


# A way's (weight, number of edits); a mark is the first letter of a row's
# role ("x": of no use, "D": the row must go), capital if the row is cut off.
Way = tuple[int, int]


def _step(way: Way, letter: str, cost: int, width: int) -> Way:
    weight, length = way
    return weight + (cost << (3 * width)) + (_DIGIT[letter] << (3 * (width - 1 - length))), length + 1


def _least(ways: dict[int, Way], state: int, way: Way) -> None:
    if state not in ways or way < ways[state]:
        ways[state] = way


def _inserted(ways: dict[int, Way], width: int, costs: Costs) -> dict[int, Way]:
    """Ways with as many empty turns after them as can be of use: two."""
    out, last = dict(ways), ways
    for _ in range(2):
        more: dict[int, Way] = {}
        for state, way in last.items():
            _least(more, _AFTER[_NEXT[state]], _step(way, "I", costs.insert, width))
        for state, way in more.items():
            _least(out, state, way)
        last = more
    return out


def cheapest(marks: str, entry: int, width: int, costs: Costs) -> dict[int, Way]:
    """Least ways from state ``entry`` over the rows to each state that can be
    reached; empty turns may stand before each row."""
    ways: dict[int, Way] = {entry: (0, 0)}
    for mark in marks:
        ways, before = {}, _inserted(ways, width, costs)
        role, cut = mark.lower(), costs.truncated if mark.isupper() else 0
        for state, way in before.items():
            _least(ways, state, _step(way, "D", costs.delete, width))
            if mark == "D":
                continue
            if state in _FROM.get(role, ()):
                _least(ways, _AFTER[role], _step(way, "K", costs.keep + cut, width))
            _least(ways, _AFTER[_NEXT[state]], _step(way, "R", costs.rerole + cut, width))
    return ways


def _width(marks: str) -> int:
    return 3 * len(marks) + 2


def _pack(cost: int, audit: str, width: int) -> Way:
    digits = int(audit.translate(_TO_DIGITS), 8) if audit else 0
    return (cost << (3 * width)) + (digits << (3 * (width - len(audit)))), len(audit)


def _unpack(way: Way, width: int) -> tuple[int, str]:
    weight, length = way
    cost = weight >> (3 * width)
    digits = (weight - (cost << (3 * width))) >> (3 * (width - length))
    return cost, oct(digits)[2:].translate(_TO_LETTERS) if length else ""


@lru_cache(maxsize=1 << 14)
def _decided(marks: str, costs: Costs) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    width = _width(marks)
    ways = _inserted(cheapest(marks, START, width, costs), width, costs)
    return _unpack(min(ways[s] for s in _DONE if s in ways), width)


def _table(marks: str, costs: Costs) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) for all states a run of rows leads between."""
    width = _width(marks)
    return [(a, b, *_unpack(way, width)) for a in range(4) for b, way in cheapest(marks, a, width, costs).items()]


def _joined(one: list, two: list) -> list[tuple[int, int, int, str]]:
    """The table of two runs of rows that follow each other."""
    width = max(len(x[3]) for x in one) + max(len(x[3]) for x in two)
    ways: dict[tuple[int, int], Way] = {}
    for a, middle, cost, audit in one:
        for state, b, more, rest in two:
            if state == middle:
                way = _pack(cost + more, audit + rest, width)
                if (a, b) not in ways or way < ways[a, b]:
                    ways[a, b] = way
    return [(a, b, *_unpack(way, width)) for (a, b), way in ways.items()]


def _ended(table: list, costs: Costs) -> tuple[int, str]:
    table = [x for x in table if x[0] == START]
    width = max(len(x[3]) for x in table) + 2
    ways = _inserted({b: _pack(cost, audit, width) for _, b, cost, audit in table}, width, costs)
    return _unpack(min(ways[s] for s in _DONE if s in ways), width)


def _turns(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each edit; ``rows`` are the rows in order."""
    rows, state = iter(rows), START
    for letter in audit:
        if letter == "I":
            state, role, text = _AFTER[_NEXT[state]], _NAMES[_NEXT[state]], ""
        else:
            role, text = next(rows)
            if letter == "K":
                state = _AFTER[role[0]]
            elif letter == "R":
                state, role = _AFTER[_NEXT[state]], _NAMES[_NEXT[state]]
        yield letter, role, text


def _digest(turns: Iterable[tuple[str, str, str]]) -> str:
    digest, first = hashlib.sha256(), True
    for letter, role, text in turns:
        if letter != "D":
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
    return digest.hexdigest()


def _mark(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "D"
    first = role[:1] if role[:1] in _AFTER else "x"
    return first.upper() if fault == "truncated" else first


def _fault(text: str) -> str:
    black = text.rstrip(SPACE)
    return "blank" if not black else "" if black[-1] in STOPS else "truncated"


def _disorder(firsts: list[str]) -> int:
    return sum(a + b not in _ORDERLY for a, b in zip(firsts, firsts[1:]))


def _gaps(turns: set) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def _examined(rows: list[dict], costs: Costs) -> dict:
    """The report on one conversation whose rows are in order."""
    seen, faults = set(), []
    for r in rows:
        fault = _fault(r["text"])
        faults.append(fault if fault == "blank" else "duplicate" if (r["role"], r["text"]) in seen else fault)
        seen.add((r["role"], r["text"]))
    cost, audit = _decided("".join(_mark(r["role"], f) for r, f in zip(rows, faults)), costs)
    return {
        "gaps": _gaps({r["turn"] for r in rows} - {None}), **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": _disorder([r["role"][:1] for r in rows]), "cost": cost, "audit": audit,
    }


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = [T.StructField(c, T.LongType()) for c in _COUNTS] + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
_TURNS = [T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
_EMITTED = 2_000  # rows of a batch that a task gives out
_EMITTED_BYTES = 4 << 20


def _batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or row.get("audit") or "")
        if len(held) >= _EMITTED or size > _EMITTED_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _short_rows(conversation: object, rows: list[dict], costs: Costs, turns: bool) -> Iterator[dict]:
    report = _examined(rows, costs)
    made = _turns(report["audit"], ((r["role"], r["text"]) for r in rows))
    if turns:
        for place, (edit, role, text) in enumerate(made):
            yield {"conv_id": conversation, "place": place, "edit": edit, "role": role, "text": text}
    else:
        yield {"conv_id": conversation, **report, "repaired_sha256": _digest(made)}


def _streamed(schema: pa.Schema, work: Callable[[object, Iterator[dict]], Iterator[dict]]):
    """A task over rows sorted by conversation that works on one at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for conversation, rows in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                yield from work(conversation, rows)

        yield from _batches(out(), schema)

    return run


def _short(rows: DataFrame, schema: T.StructType, costs: Costs, turns: bool) -> DataFrame:
    def work(conversation: object, rows: Iterator[dict]) -> Iterator[dict]:
        return _short_rows(conversation, [r for r in rows if not r["absent"]], costs, turns)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_streamed(to_arrow_schema(schema), work), schema)


_ENTRY = "struct<entry:int,exit:int,cost:long,audit:string>"


def _piece(costs: Costs, pdf: pd.DataFrame) -> pd.DataFrame:
    """The table of a piece: its rows in order, ``marks`` with repeats."""
    pdf = pdf.sort_values("at")
    firsts = [f for f, n in zip(pdf["first"], pdf["copies"]) for f in [f] * min(int(n), 2)]
    # Copies beyond the second add one more pair of the same letter each.
    illegal = _disorder(firsts) + sum(max(int(n) - 2, 0) for n in pdf["copies"])
    entries = [dict(zip(("entry", "exit", "cost", "audit"), x)) for x in _table("".join(pdf["marks"]), costs)]
    return pd.DataFrame({
        "conv_id": [pdf["conv_id"].iloc[0]], "place": [pdf["place"].iloc[0]], "illegal": [illegal],
        "begins": [firsts[0]], "ends": [firsts[-1]], "entries": [entries],
    })


def _merged(costs: Costs, pdf: pd.DataFrame) -> pd.DataFrame:
    """One table for the neighbouring pieces of a group."""
    pdf = pdf.sort_values("place")
    table, illegal, last = None, 0, None
    for r in pdf.itertuples():
        entries = [(x["entry"], x["exit"], x["cost"], x["audit"]) for x in r.entries]
        table = entries if table is None else _joined(table, entries)
        illegal += r.illegal + (last is not None and last + r.begins not in _ORDERLY)
        last = r.ends
    return pd.DataFrame({
        "conv_id": [pdf["conv_id"].iloc[0]], "place": [pdf["group"].iloc[0]], "illegal": [illegal], "begins": [pdf["begins"].iloc[0]],
        "ends": [last], "entries": [[dict(zip(("entry", "exit", "cost", "audit"), x)) for x in table]],
    })


def _final(schema: pa.Schema, costs: Costs):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for r in _rows(batches):
                cost, audit = _ended([(x["entry"], x["exit"], x["cost"], x["audit"]) for x in r["entries"]], costs)
                yield {"conv_id": r["conv_id"], "illegal": r["illegal"], "cost": cost, "audit": audit}

        yield from _batches(out(), schema)

    return run


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    on = F.lit(True)
    for name in names:
        on = on & a[name].eqNullSafe(b[name])
    return on


def _long(rows: DataFrame, schema: T.StructType, costs: Costs, turns: bool) -> DataFrame:
    spark, id_type = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    there = rows.where(~F.col("absent"))
    equal = there.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    first = equal.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("t"))
    first = first.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "text")), F.col("t.turn").alias("_turn"), F.lit(True).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "role", "text", "turn")]
    joined = equal.join(first, same, "left")
    black = F.rtrim("text", F.lit(SPACE))
    truncated = ~F.substring(black, -1, 1).isin(*STOPS)
    begins = F.substring("role", 1, 1)
    letter = F.when(begins.isin(*_AFTER), begins).otherwise("x")
    letter = F.when(truncated, F.upper(letter)).otherwise(letter)
    is_first = F.coalesce("_first", F.lit(False))
    marks = F.when((black == "") | ~is_first, F.repeat(F.lit("D"), F.col("copies").cast("int"))).otherwise(F.concat(letter, F.repeat(F.lit("D"), (F.col("copies") - 1).cast("int"))))
    marked = joined.select(
        "conv_id", "turn", "role", "text", "copies", marks.alias("marks"), begins.alias("first"),
        F.when(black == "", F.col("copies")).otherwise(0).alias("blank"),
        F.when(black == "", 0).when(is_first, F.col("copies") - 1).otherwise(F.col("copies")).alias("duplicate"),
        ((black != "") & is_first & truncated).cast("long").alias("truncated"),
    )
    order = ["conv_id", "turn", "role", "text"]
    marked = marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    marked = staged(marked, "turns")
    counted = marked.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
    )
    form = f"conv_id {id_type}, place long, illegal long, begins string, ends string, entries array<{_ENTRY}>"
    piece = F.floor(F.col("at") / PIECE_ROWS).alias("place")
    pieces = marked.select("conv_id", "at", "marks", "first", "copies", piece).groupBy("conv_id", "place").applyInPandas(lambda pdf: _piece(costs, pdf), form)
    pieces = staged(pieces, "pieces")
    # Neighbours within a partition meet first, then those of partitions.
    while not pieces.groupBy("conv_id").count().where("count > 1").isEmpty():
        groups = pieces.withColumn("group", F.shiftright("place", FAN)).groupBy("conv_id", "group")
        pieces = staged(groups.applyInPandas(lambda pdf: _merged(costs, pdf), form), "pieces")
    fields = [T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]
    ending = T.StructType([schema["conv_id"], *fields])
    decided = staged(pieces.mapInArrow(_final(to_arrow_schema(ending), costs), ending), "audits")

    # The rows behind their audit, in order: one run over each conversation.
    nothing = [F.lit(None).cast("string").alias(c) for c in ("role", "text")]
    heads = decided.select("conv_id", F.lit(-1).cast("long").alias("at"), *nothing, F.lit(0).cast("long").alias("copies"), "audit")
    body = marked.select("conv_id", "at", "role", "text", "copies", F.lit(None).cast("string").alias("audit"))

    def replay(conversation: object, rows: Iterator[dict]) -> Iterator[dict]:
        audit = next(rows)["audit"]
        made = _turns(audit, ((r["role"], r["text"]) for r in rows for _ in range(r["copies"])))
        if turns:
            for place, (edit, role, text) in enumerate(made):
                yield {"conv_id": conversation, "place": place, "edit": edit, "role": role, "text": text}
        else:
            yield {"conv_id": conversation, "repaired_sha256": _digest(made)}

    shape = schema if turns else T.StructType([schema["conv_id"], schema["repaired_sha256"]])
    stream = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    made = stream.mapInArrow(_streamed(to_arrow_schema(shape), replay), shape)
    if turns:
        return made
    out = counted.join(decided, _same(counted, decided, "conv_id")).join(made, _same(counted, made, "conv_id"))
    out = out.select(counted["conv_id"], "gaps", "blank", "duplicate", "truncated", decided["illegal"], decided["cost"], decided["audit"], "repaired_sha256")
    # Conversations of which all rows are absent.
    bare = rows.groupBy("conv_id").agg(F.min("absent").alias("none")).where("none")
    zeros = bare.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in _COUNTS), F.lit("").alias("audit"), F.lit(_digest(())).alias("repaired_sha256"))
    return out.unionByName(zeros).to(schema)


def _repaired(rows: DataFrame, costs: Costs, turns: bool) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    absent = F.coalesce(F.col("absent"), F.lit(False)) if "absent" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", plain("role"), plain("text"), absent.alias("absent"))
    schema = T.StructType([rows.schema["conv_id"], *(_TURNS if turns else _REPORT)])
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    long = staged(sizes.where((F.col("n") > SHORT_ROWS) | (F.col("bytes") > SHORT_BYTES)).select("conv_id"), "long_conversations")
    if long.isEmpty():
        return _short(rows, schema, costs, turns)
    some = rows.join(long, _same(rows, long, "conv_id"), "left_anti")
    rest = rows.join(long, _same(rows, long, "conv_id"), "left_semi")
    return _short(some, schema, costs, turns).unionByName(_long(rest, schema, costs, turns))


def report(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text and
    optionally absent): gaps, blank, duplicate, truncated, illegal (neighbours
    whose roles do not follow each other), cost, audit and the digest of the
    repaired turns, one ``role:text`` a line."""
    return _repaired(rows, costs, turns=False)


def repaired(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The edits themselves: (conv_id, place, edit, role, text) in order of
    ``place`` for each conversation; deleted rows (D) are listed too."""
    return _repaired(rows, costs, turns=True)


def damage(rows: DataFrame) -> DataFrame:
    """Planted faults for trials: by the checksum of ``conv_id:turn`` (null:
    one space) modulo 20 a row is dropped (0; it stays as absent), emptied (1),
    loses its sentence ends (2), stands twice (3) or becomes the user's (4)."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(kind == 4, "user").otherwise(plain("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("absent"), F.when(kind == 3, 2).otherwise(1).alias("_times"))
    return out.withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times")
