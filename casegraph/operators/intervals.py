"""Joins over time that spread a busy key over tasks: interval against interval, and the last state before a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import saved

#: Lengths of slots, in seconds, from one level to the next; with so many levels the last is longer than any table's time.
BASE, LEVELS = 8, 14


def _level(start: Column, end: Column) -> Column:
    """The first level whose slots are at least as long as the interval, so that it lies in two of them at most."""
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(end - start <= BASE**k, k).otherwise(out)
    return out


def _slots(df: DataFrame, levels: Column) -> DataFrame:
    """A row for each slot that an interval touches at levels (an array)."""
    size = F.element_at(F.array(*[F.lit(BASE**k) for k in range(LEVELS)]), F.col("at_level") + 1)
    rows = df.withColumn("at_level", F.explode(levels)).withColumn("first_slot", F.floor(F.col("from_") / size))
    return rows.withColumn("slot", F.explode(F.sequence(F.col("first_slot"), F.floor(F.col("to_") / size))))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], span_a: tuple[str, str], span_b: tuple[str, str]) -> DataFrame:
    """Pairs of rows of a and b with equal keys whose spans (start, end in whole seconds, ends included) overlap; other columns of a and b must differ.

    Time is cut into slots of 1, 8, 64, ... seconds. An interval has the level at which it lies in one or two slots, and a pair meets
    at the coarser of its two levels, in the first slot that both touch, so once. One of the two is at its own level there and
    fills a good part of its slots: what meets without overlapping is at most a constant times what overlaps, on even data. A row is
    copied for each level that the other side has, LEVELS at most. Rows with a null key or end, or that end before they start, meet nothing.
    """
    a = a.withColumns({"from_": F.col(span_a[0]).cast("long"), "to_": F.col(span_a[1]).cast("long")}).where("from_ <= to_")
    b = b.withColumns({"from_": F.col(span_b[0]).cast("long"), "to_": F.col(span_b[1]).cast("long")}).where("from_ <= to_")
    a, b = (saved(x.withColumn("level", _level(F.col("from_"), F.col("to_")))) for x in (a, b))  # each is read three times
    present = lambda x: sorted(r["level"] for r in x.select("level").distinct().collect())  # at most LEVELS numbers
    in_a, in_b = present(a), present(b)
    above = lambda levels, least: F.filter(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), least)

    def met(own: DataFrame, up: DataFrame, levels: list[int], strictly: bool) -> DataFrame:
        own = _slots(own, F.array("level")).withColumnsRenamed({c: f"{c}own" for c in ("from_", "to_", "level", "first_slot")})
        up = _slots(up, above(levels, lambda k: (k > F.col("level")) if strictly else (k >= F.col("level")))).withColumnsRenamed({c: f"{c}up" for c in ("from_", "to_", "level", "first_slot")})
        rows = own.join(up, [*keys, "at_level", "slot"])
        return rows.where("slot = greatest(first_slotown, first_slotup) AND from_own <= to_up AND from_up <= to_own")

    cols = [*keys, *[c for c in a.columns if c not in keys and c not in ("from_", "to_", "level")], *[c for c in b.columns if c not in keys and c not in ("from_", "to_", "level")]]
    return met(a, b, in_a, False).select(*cols).unionByName(met(b, a, in_b, True).select(*cols))


def overlapping_pairs(rows: DataFrame, keys: list[str], span: tuple[str, str], order: list[str]) -> DataFrame:
    """(keys, order with _1, order with _2): pairs of rows of one table with equal keys whose spans overlap, each pair once, the row that is first by order first.

    Pairs meet as in overlapping(), but as both sides are one table, the coarser of two rows meets the finer, and of two rows of one level
    the first meets the second. Rows whose key no other row has meet nothing; they are left out by a count before anything is
    copied. Rows that are equal in order make no pair.
    """
    rows = rows.select(*keys, *order, F.col(span[0]).cast("long").alias("from_"), F.col(span[1]).cast("long").alias("to_")).where("from_ <= to_").withColumn("key_", F.xxhash64(*keys))
    often = saved(rows.groupBy("key_").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key_"))  # a table, as Spark then knows whether it can be broadcast
    rows = saved(rows.join(often, "key_", "left_semi").drop("key_").withColumn("level", _level(F.col("from_"), F.col("to_"))))
    levels = sorted(r["level"] for r in rows.select("level").distinct().collect())  # at most LEVELS numbers
    above = F.filter(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), lambda k: k >= F.col("level"))

    def side(levels: Column, name: str) -> DataFrame:
        slots = _slots(rows, levels).select(*keys, "at_level", "slot", "level", "from_", "to_", *order)
        return slots.withColumnsRenamed({c: f"{c}{name}" for c in ("level", "from_", "to_", *order)})

    def earlier(x: str, y: str) -> Column:
        out = F.lit(False)
        for c in reversed(order):
            out = (F.col(c + x) < F.col(c + y)) | ((F.col(c + x) == F.col(c + y)) & out)
        return out

    met = side(F.array("level"), "_own").join(side(above, "_up"), [*keys, "at_level", "slot"])
    size = F.element_at(F.array(*[F.lit(BASE**k) for k in range(LEVELS)]), F.col("at_level") + 1)
    met = met.where((F.col("slot") == F.floor(F.greatest("from__own", "from__up") / size)) & F.expr("from__own <= to__up AND from__up <= to__own"))
    met = met.withColumn("own_first", earlier("_own", "_up")).where(F.col("own_first") | ((F.col("level_up") < F.col("level_own")) & earlier("_up", "_own")))
    pick = lambda c, x, y: F.when(F.col("own_first"), F.col(c + x)).otherwise(F.col(c + y))
    return met.select(*keys, *[pick(c, "_own", "_up").alias(f"{c}_1") for c in order], *[pick(c, "_up", "_own").alias(f"{c}_2") for c in order])


def as_of(rows: DataFrame, states: DataFrame, keys: list[str], value: str, slot: int = 3600) -> DataFrame:
    """Adds to each row the value of the last state at or before it. rows: (keys, epoch, ...), states: (keys, epoch, value).

    Time is cut into slots. Within a slot of a key one sort finds the last state; what a slot starts with is the last state of an earlier
    slot, found over one row for each slot of a key. So a busy key is many tasks' work, and its second sort has no more rows than
    its time has slots. Of states of one second the largest value is the last; states without a value are none. A null key is a
    key of its own. There may be any number of rows of one second, all get the same.
    """
    number = F.floor(F.col("epoch") / slot)
    kind = states.schema[value].dataType
    a = rows.withColumns({"_slot": number, "_side": F.lit(1), "_value": F.lit(None).cast(kind)})
    b = states.where(F.col(value).isNotNull() & F.col("epoch").isNotNull()).select(*keys, "epoch", F.col(value).alias("_value")).withColumns({"_slot": number, "_side": F.lit(0)})
    inside = Window.partitionBy(*keys, "_slot").orderBy("epoch", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b, allowMissingColumns=True).withColumn("_value", F.last("_value", ignorenulls=True).over(inside)).where("_side = 1").drop("_side")
    last = b.groupBy(*keys, "_slot").agg(F.max(F.struct("epoch", "_value")).alias("_last"))
    slots = _slots_of(a, last, keys)
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select(*keys, "_slot", F.col("_carried._value").alias("_carried"))
    x, y = found.alias("x"), carried.alias("y")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*keys, "_slot"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    names = [c for c in rows.columns if c != value]
    return x.join(y, on, "left").select(*[F.col(f"x.{c}") for c in names], F.coalesce("x._value", "y._carried").alias(value))


def _slots_of(a: DataFrame, last: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _slot, _last): a row for each slot with rows or states."""
    none = F.lit(None).cast(last.schema["_last"].dataType)
    both = a.select(*keys, "_slot").distinct().withColumn("_last", none).unionByName(last.select(*keys, "_slot", "_last"))
    return both.groupBy(*keys, "_slot").agg(F.max("_last").alias("_last"))
