"""Operators over an order: order statistics, numbering, and folds that survive a key with most of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.sources.tables import written

#: Rows up to which an order statistic is found by one sort.
SMALL = 50_000
NEAR = 0.002


def order_statistic(df: DataFrame, column: str, k: int) -> float:
    """The value at place k (from 0) in order, exactly: approximate quantiles bracket it, counts correct the place, and only the bracket is searched on."""
    c = F.col(column)
    rows, n = df.select(column), df.count()
    while n > SMALL:
        lo, hi = rows.approxQuantile(column, [max(0.0, k / n - NEAR), min(1.0, k / n + NEAR)], NEAR / 2)
        below, at_lo, inside = rows.agg(F.count_if(c < lo), F.count_if(c == lo), F.count_if((c > lo) & (c <= hi))).first()
        if below <= k < below + at_lo:
            return lo
        if k < below:
            rows, n = rows.where(c < lo), below
        elif k < below + at_lo + inside:
            rows, k, n = rows.where((c > lo) & (c <= hi)), k - below - at_lo, inside
        else:
            rows, k, n = rows.where(c > hi), k - below - at_lo - inside, n - below - at_lo - inside
    return rows.orderBy(column).limit(k + 1).agg(F.max(column)).first()[0]


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows sorted by range, fixed, with ``__part`` and ``__place`` (from 0 in each part)."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return written(sorted_.withColumns({"__part": F.shiftright("__at", 33).cast("int"), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at"), "placed")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name`` counts rows from 1 in the order of the columns: sorted by range, numbered in each part; only the parts' sizes reach the driver."""
    fixed = placed(df, order)
    total, rows = 0, []
    for r in sorted(fixed.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        rows.append((r["__part"], total))
        total += r["n"]
    starts = df.sparkSession.createDataFrame(rows, "__part int, __before long")
    return fixed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")


#: Grid of mastery levels: four places from 0 to 1.
LEVELS = 10_000
OLD, NEW, START = 0.7, 0.3, 0.5


def next_level(level, ratio: float):
    """One step of the moving average on the grid of levels; half to even, as the levels are stored."""
    return np.rint(np.clip(OLD * (level / LEVELS) + NEW * ratio, 0.0, 1.0) * LEVELS).astype(np.int64)


def mastery(df: DataFrame, keys: list[str], order: list[str], ratio: str) -> DataFrame:
    """keys, n, level: the moving average of ``ratio`` from 0.5 on, rounded to four places at each step.

    Rounding makes each step depend on the last, so sums can't replace it. But a run of steps
    maps the 10,001 levels to themselves, and maps compose: rows are sorted by range of key and
    order and each part folds its keys' runs. Only a part's first run can have begun before, so
    only that is folded as a map; a key over several parts has its maps applied in turn. No task
    needs all rows of a key. Null ratios are left out.
    """
    sorted_ = df.where(F.col(ratio).isNotNull()).select(*keys, *[c for c in order if c not in keys], F.col(ratio).cast("double").alias("__ratio"))
    sorted_ = sorted_.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kept = sorted_.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", part int, n long, level int, map array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, n, level, first = TaskContext.get().partitionId(), None, 0, 0, True
        back = np.zeros(0, np.int64)  # while the first run lasts: its levels' places among the different ones in ``level``
        kinds, out = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [*(f.name for f in kept), "part", "n", "level", "map"]
            types = [*kinds, pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def row() -> tuple:
            return (*key, part, n, None, level[back].tolist()) if first else (*key, part, n, int(level), None)

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(keys))]
            rows = zip(zip(*(batch.column(i).to_pylist() for i in range(len(keys)))), batch.column(batch.num_columns - 1).to_pylist())
            for k, r in rows:
                if k != key:
                    if key is not None:
                        out.append(row())
                        first = False
                    key, n, level = k, 0, START
                    level = int(START * LEVELS) if out or not first else np.arange(LEVELS + 1)
                    back = np.arange(LEVELS + 1)
                n += 1
                if first:
                    level, merged = np.unique(next_level(level, r), return_inverse=True)
                    back = merged[back]
                else:
                    level = round(min(1.0, max(0.0, OLD * (level / LEVELS) + NEW * r)) * LEVELS)
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
                first = False
        if key is not None:
            out.append(row())
        if out:
            yield batch_of(out)

    runs = sorted_.select(*keys, "__ratio").mapInArrow(run, schema).groupBy(*keys).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "level", "map"))).alias("runs"))
    level = F.aggregate("runs", F.lit(int(START * LEVELS)), lambda now, r: F.coalesce(r["level"], F.element_at(r["map"], now + 1)))
    return runs.select(*keys, "n", (level / F.lit(float(LEVELS))).alias("level"))


def streaks(df: DataFrame, keys: list[str], order: list[str], ok: str) -> DataFrame:
    """keys, streak: how many of the last rows are all right: rows after the last that isn't, by two aggregations."""
    place = F.struct(*order)
    last_bad = df.groupBy(*keys).agg(F.max(F.when(~F.col(ok), place)).alias("__bad"))
    return df.join(last_bad, keys).groupBy(*keys).agg(F.count_if(F.col("__bad").isNull() | (place > F.col("__bad"))).alias("streak"))


def last_two(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, last, before: the values of the last two rows; partial maxima, no window."""
    place = F.struct(*order, F.col(value).alias("__v"))
    newest = df.groupBy(*keys).agg(F.max(place).alias("__1"))
    others = df.join(newest, keys).where(F.struct(*order) < F.struct(*[F.col(f"__1.{c}") for c in order]))
    second = others.groupBy(*keys).agg(F.max(place).alias("__2"))
    return newest.join(second, keys, "left").select(*keys, F.col("__1.__v").alias("last"), F.col("__2.__v").alias("before"))


def status(last: Column, before: Column, high: float = 0.8) -> Column:
    return F.when((last >= high) & (before >= high), "mastered").otherwise("pending")


def difficulty(last: Column, before: Column, now: Column, high: float = 0.8, low: float = 0.5) -> Column:
    """One up after two good scores, one down after two poor ones, between 1 and 3."""
    step = F.when((last >= high) & (before >= high), 1).when((last < low) & (before < low), -1).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(3), now + step))


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, with partial maxima of whole rows; ``order`` must tell the rows of a key apart."""
    others = [c for c in df.columns if c not in (*keys, *order)]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *others)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in [*order, *others]])


def sequence(df: DataFrame, keys: list[str], order: list[str], name: str = "sequence_no", start: int = 0) -> DataFrame:
    """``name`` counts the rows of each key in order, from ``start``. Null keys are one key.

    Rows are sorted by range of key and order and counted within key and part. Of a part's keys only
    the first can have begun in another part; how many rows it had there is carried over, from one
    row for each part on the driver. No task needs all rows of a key.
    """
    fixed = placed(df, [*keys, *order])
    runs = fixed.groupBy("__part", *keys).agg(F.count("*").alias("n"), F.min("__place").alias("at"))
    run = F.struct(F.struct(*keys).alias("key"), "n")
    ends = runs.groupBy("__part").agg(F.min_by(run, "at").alias("first"), F.max_by(run, "at").alias("last"), F.count("*").alias("runs"))
    rows, key, held = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        before = held if key is not None and r["first"]["key"] == key else 0
        rows.append((r["__part"], before, r["first"]["n"]))
        key, held = r["last"]["key"], r["last"]["n"] + (before if r["runs"] == 1 else 0)
    carried = df.sparkSession.createDataFrame(rows, "__part int, __before long, __first long")
    own = F.row_number().over(W.partitionBy("__part", *keys).orderBy("__place"))
    with_ = fixed.withColumn("__own", own).join(F.broadcast(carried), "__part")  # a row for each part
    number = F.col("__own") + F.when(F.col("__place") < F.col("__first"), F.col("__before")).otherwise(0) - 1 + start
    return with_.withColumn(name, number.cast("int")).drop("__part", "__place", "__before", "__first", "__own")


def in_window(df: DataFrame, keys: list[str], seconds: Column, span: int = 300, name: str = "recent") -> DataFrame:
    """How many earlier rows of a key lie in the ``span`` seconds before each row.

    Rows are dealt by key and stretch of ``span`` seconds, each also to the stretch after its own,
    where it only counts; so a key is spread over its time.
    """
    timed = df.withColumn("__s", seconds)
    dealt = timed.withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__stretch", F.floor(F.col("__s") / span) + F.col("__copy"))
    dealt = dealt.where((F.col("__copy") == 0) | F.col("__s").isNotNull())
    w = W.partitionBy(*keys, "__stretch").orderBy("__s").rangeBetween(-(span - 1), -1)
    return dealt.withColumn(name, F.count("*").over(w)).where("__copy = 0").drop("__s", "__copy", "__stretch")


def allowed_attempts(df: DataFrame, keys: list[str], seconds: str, order: list[str], most: int = 5, span: int = 300) -> DataFrame:
    """``accepted`` for each attempt: fewer than ``most`` accepted ones in the ``span`` seconds before.

    Rejected attempts leave no trace, so the last ``most`` accepted times are the whole state of a key.
    Attempts are sorted by range of key and time. Parts are worked on side by side, each from the state
    in which the part before ends; where that turns out to be another than was assumed, the part is done
    again, until all agree. Only a part within one key passes a state on, so a round more is needed
    for each part of a key's densest stretch at worst, and two or three in all where attempts pause for
    ``span`` seconds. No task needs all rows of a key; a row for each part reaches the driver. Rows
    without a time are not accepted and count for nothing.
    """
    fixed = placed(df.withColumn("__s", F.col(seconds).cast("double")), [*keys, "__s", *order])
    shape = fixed.select("__part", "__place", "__s", *keys)
    in_order = lambda rows: rows.repartition("__part").sortWithinPartitions("__part", "__place")

    def verdicts(batches: Iterator[pa.RecordBatch], begin: dict[int, list[float]]) -> Iterator[tuple]:
        """For each batch its verdicts; and for each part its number, keys, first time and state at the end."""
        at, key, held, parts = None, None, [], {}
        for batch in batches:
            made = []
            for part, t, k in zip(batch.column("__part").to_pylist(), batch.column("__s").to_pylist(), zip(*(batch.column(c).to_pylist() for c in keys))):
                if part != at:
                    at, key, held = part, k, list(begin.get(part, []))
                    parts[part] = {"first": k, "from": t, "several": False}
                elif k != key:
                    key, held = k, []
                    parts[part]["several"] = True
                ok = False
                if t is not None:
                    held = [x for x in held if x > t - span]
                    ok = len(held) < most
                    if ok:
                        held.append(t)
                made.append(ok)
                parts[part] |= {"last": k, "held": held}
            yield batch, made, parts

    spark, begin, told, stale = df.sparkSession, {}, {}, None
    while stale is None or stale:
        shared = spark.sparkContext.broadcast(begin)

        def ends(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            parts = {}
            for _, _, parts in verdicts(batches, shared.value):
                pass
            for part, r in parts.items():
                columns = [[part], [repr(r["first"])], [repr(r["last"])], [r["from"]], [r["several"]], [r["held"]]]
                types = [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "first", "last", "start", "several", "held"])

        asked = shape if stale is None else shape.where(F.col("__part").isin(stale))
        for r in in_order(asked).mapInArrow(ends, "part int, first string, last string, start double, several boolean, held array<double>").collect():
            told[r["part"]] = r
        stale, key, held = [], None, []
        for part in sorted(told):
            r = told[part]
            entry = [x for x in held if r["start"] is None or x > r["start"] - span] if r["first"] == key else []
            if entry != begin.get(part, []):
                stale.append(part)
            begin = begin | {part: entry}
            key, held = r["last"], r["held"]
    shared = spark.sparkContext.broadcast(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made, _ in verdicts(batches, shared.value):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.bool_())], names=[*batch.schema.names, "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fixed.schema) + ", accepted boolean"
    return in_order(fixed).mapInArrow(run, schema).drop("__part", "__place", "__s")


#: Rows up to which a group is sorted whole, and how exact the quantiles are that bracket a place in larger ones.
FEW, CLOSE = 1000, 0.001


def order_statistics(df: DataFrame, keys: list[str], column: str, places: dict[str, tuple[float, str]]) -> DataFrame:
    """keys, n, and for each name the value at its place in its key's order, exactly and for all keys at once.

    A place is a fraction and SQL of the place (from 0) for ``n`` rows, such as ``(0.5, "n div 2")``. Null
    values don't count; a key without any value has no row, an empty table none. Null keys are one key.
    Approximate quantiles bracket each place, counts tell what lies below and on the brackets, and only values strictly
    between them are sorted, by range over all keys: no task needs all rows of a key, and values
    equal to a bracket, however many, are not moved. A bracket that misses its place takes the whole key.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("__v"))
    around = [p for near, _ in places.values() for p in (max(0.0, near - CLOSE), min(1.0, near + CLOSE))]
    of_key = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__v", around, int(4 / CLOSE)).alias("__q")), "quantiles")
    bracket = lambda i: F.when(F.col("n") > FEW, F.col("__q")[i])
    wanted = [F.struct(F.lit(name).alias("__name"), F.expr(at).cast("long").alias("__k"), bracket(2 * i).alias("__lo"), bracket(2 * i + 1).alias("__hi")) for i, (name, (_, at)) in enumerate(places.items())]
    asked = of_key.select(*keys, F.explode(F.array(*wanted)).alias("__w")).select(*keys, "__w.*")

    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]

    def with_rows(targets: DataFrame) -> DataFrame:
        own = targets.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], "__name", "__k", "__lo", "__hi", *[c for c in targets.columns if c == "__below"])
        return rows.join(own, same).drop(*[f"__key{i}" for i in range(len(keys))])

    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    one = ["__name", "__k", "__lo", "__hi"]
    large = with_rows(asked.where("__lo is not null")).groupBy(*keys, *one).agg(F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_lo"), F.count_if((v > lo) & (v < hi)).alias("within"), F.count_if((v == hi) & (v > lo)).alias("at_hi"))
    large = written(large, "brackets")
    found = large.select(
        *keys, *one, F.expr("below + at_lo").alias("__below"),
        F.expr("case when __k < below or __k >= below + at_lo + within + at_hi then 'missed' when __k < below + at_lo then 'lo' when __k >= below + at_lo + within then 'hi' else 'within' end").alias("where"),
    )
    ready = found.where("where in ('lo', 'hi')").select(*keys, "__name", F.when(F.col("where") == "lo", lo).otherwise(hi).alias("__v"))
    missed = found.where("where = 'missed'").select(*keys, "__name", "__k", F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi"), F.lit(0).cast("long").alias("__below"))
    whole = asked.where("__lo is null").withColumn("__below", F.lit(0).cast("long")).unionByName(missed)
    inside = with_rows(found.where("where = 'within'").drop("where").unionByName(whole)).where(lo.isNull() | ((v > lo) & (v < hi)))
    sorted_ = sequence(inside, [*keys, "__name"], ["__v"], "__at").where("__at = __k - __below").select(*keys, "__name", "__v")
    values = sorted_.unionByName(ready)
    got = values.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, v)).alias(name) for name in places])
    names = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    return of_key.select(*names, "n").join(got, same).select(*keys, "n", *places)
