"""Exact nearest-rank percentiles without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.session import is_small, staged

# Values that may be put in order together.
ORDERED = 100_000
ACCURACY = 10_000
# Marks of the sketch that narrows a zone: a zone shrinks to about two steps.
STEPS = 1_000


def nearest_rank(p: float, n: Column) -> Column:
    """Zero-based rank of the p-th percentile (0..1) among n ascending values."""
    return F.floor(F.lit(float(p)) * (n - 1) + F.lit(0.5)).cast("long")


def _same(key: list[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return on


def _met(values: DataFrame, zones: DataFrame, key: list[str]) -> DataFrame:
    """Each value with the zones of its group that hold it."""
    rest = [c for c in zones.columns if c not in key]
    if key:
        zones = F.broadcast(zones) if is_small(zones) else zones
        both = values.alias("v").join(zones.alias("z"), _same(key, "v", "z")).select(*[F.col(f"v.`{c}`").alias(c) for c in key], "v._v", *[f"z.{c}" for c in rest])
    else:
        # One zone for each wanted percentile at most.
        held = zones.collect()
        struct = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in zones.schema.fields)
        rows = F.from_json(F.lit(_json(held)), f"array<struct<{struct}>>")
        both = values.select("_v", F.explode(rows).alias("z")).select("_v", *[f"z.{c}" for c in rest])
    above = F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))
    return both.where(above & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi"))))


def _json(rows: list) -> str:
    """Exact text of a few rows; infinities and NaN are quoted for Spark."""
    import json

    odd = {float("inf"): "Infinity", float("-inf"): "-Infinity"}
    plain = lambda x: x if not isinstance(x, float) else "NaN" if x != x else odd.get(x, x)
    return json.dumps([{k: [plain(y) for y in v] if isinstance(v, list) else plain(v) for k, v in r.asDict().items()} for r in rows])


def _narrowed(values: DataFrame, zones: DataFrame, key: list[str]) -> DataFrame:
    """Zones cut down to the part that holds their rank, which counts prove.

    A sketch of the values inside proposes two marks around the rank. The
    values below, at, between, at and above the marks are counted, so the rank
    is known to lie in one of these five parts, whatever the sketch's error.
    """
    own = [*key, "_w"]
    marks = [i / STEPS for i in range(STEPS + 1)]
    sketch = _met(values, zones, key).groupBy(*own).agg(F.percentile_approx("_v", marks, ACCURACY).alias("_marks"))
    rank = F.col("_rank") - F.col("_base")
    near = rank / F.greatest(F.col("_inside") - 1, F.lit(1)) * STEPS
    mark = lambda at: F.get("_marks", F.greatest(F.lit(0), F.least(F.lit(STEPS), at.cast("int"))))
    marked = zones.alias("z").join(sketch.alias("s"), _same(own, "z", "s")).select("z.*", "s._marks")
    marked = marked.withColumns({"_a": mark(F.floor(near) - 1), "_b": mark(F.ceil(near) + 1)}).drop("_marks")
    marked = staged(marked, "percentile-marks")
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    parts = {"_c0": v < a, "_c1": v == a, "_c2": (v > a) & (v < b), "_c3": (v == b) & (b > a)}
    counts = _met(values, marked, key).groupBy(*own).agg(*[F.count_if(c).alias(n) for n, c in parts.items()])
    both = marked.alias("z").join(counts.alias("s"), _same(own, "z", "s")).select("z.*", *[f"s.{n}" for n in parts])
    to1, to2, to3, to4 = (sum((F.col(f"_c{i}") for i in range(n)), F.lit(0)) for n in (1, 2, 3, 4))
    place = F.when(rank < to1, 0).when(rank < to2, 1).when(rank < to3, 2).when(rank < to4, 3).otherwise(4)
    both = both.withColumn("_p", place)
    of = lambda *choices: F.element_at(F.array(*choices), F.col("_p") + 1)
    lo, hi = F.col("_lo"), F.col("_hi")
    new = {
        "_at": F.when(F.col("_p") == 1, a).when(F.col("_p") == 3, b),
        "_inside": of(F.col("_c0"), F.col("_c1"), F.col("_c2"), F.col("_c3"), F.col("_inside") - to4),
        "_base": F.col("_base") + of(F.lit(0), to1, to2, to3, to4),
        "_lo": of(lo, a, a, b, b), "_hi": of(a, a, b, b, hi),
    }
    return both.select(*own, "_rank", *[c.alias(n) for n, c in new.items()]).select(*zones.columns)


def percentiles(df: DataFrame, value: str, wanted: Sequence[tuple[str, float]], group: Sequence[str] = ()) -> DataFrame:
    """Per group: ``n``, ``mean`` and each wanted (name, p) percentile, exact.

    A zone of values that holds the wanted rank is narrowed, round by round,
    until at most ORDERED values are left or all left are equal; only then is
    anything put in order, equal values merged before. Rounds only count, so no
    task holds or sorts more, however hot a group is. Groups of fewer rows take
    no round. Null values are left out; zeros stand for an empty input without
    groups.
    """
    key = list(group)
    names = [name for name, _ in wanted]
    values = df.select(*key, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    totals = values.groupBy(*key).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    if not key:
        only = totals.first()
        if not only["n"]:
            return df.sparkSession.range(1).select(
                F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in ("mean", *names)]
            )
        totals = df.sparkSession.range(1).select(F.lit(only["n"]).cast("long").alias("n"), F.lit(only["mean"]).alias("mean"))
    else:
        totals = staged(totals, "percentile-totals")
    ranks = F.array(*[F.struct(F.lit(i).alias("_w"), nearest_rank(p, F.col("n")).alias("_rank")) for i, (_, p) in enumerate(wanted)])
    none = F.lit(None).cast("double")
    zones = totals.select(*key, "n", F.explode(ranks).alias("r")).select(
        *key, "r._w", "r._rank", none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_base"), F.col("n").alias("_inside"), none.alias("_at")
    )
    wide = (F.col("_inside") > ORDERED) & F.col("_at").isNull()
    while not zones.where(wide).isEmpty():
        zones = staged(zones.where(~wide).unionByName(_narrowed(values, staged(zones.where(wide), "percentile-zones"), key)), "percentile-zones")
    inside = _met(values, zones.where("_at is null").select(*key, "_w", "_rank", "_lo", "_hi", "_base"), key)
    merged = inside.groupBy(*key, "_w", "_rank", "_base", "_v").agg(F.count("*").alias("_c"))
    upto = F.col("_base") + F.sum("_c").over(Window.partitionBy(*key, "_w").orderBy("_v"))
    ordered = merged.withColumn("_upto", upto).where(F.col("_upto") > F.col("_rank")).groupBy(*key, "_w").agg(F.min("_v").alias("_at"))
    found = ordered.unionByName(zones.where("_at is not null").select(*key, "_w", "_at"))
    found = found.groupBy(*key).agg(*[F.min(F.when(F.col("_w") == i, F.col("_at"))).alias(name) for i, name in enumerate(names)])
    if key:
        return totals.alias("t").join(found.alias("f"), _same(key, "t", "f")).select("t.*", *[f"f.`{c}`" for c in names])
    return found.select(F.lit(only["n"]).alias("n"), F.lit(only["mean"]).alias("mean"), *names)


def approx_percentiles(
    df: DataFrame, value: str, wanted: Sequence[tuple[str, float]], group: Sequence[str] = (), accuracy: int = ACCURACY
) -> DataFrame:
    """One-pass variant with a bounded rank error of n/accuracy."""
    return df.groupBy(*group).agg(
        F.count(value).alias("n"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        *[F.coalesce(F.percentile_approx(value, p, accuracy), F.lit(0.0)).alias(name) for name, p in wanted],
    )
