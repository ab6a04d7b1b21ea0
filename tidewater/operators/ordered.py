"""Scans over a whole table in one order, without bringing it to one task.

A table is dealt out by ranges of the order, each range is scanned where it lies, and what one range hands to the next
(a sum, a last value) is worked out from one row for each range. Those rows are as many as partitions; they are the
only thing that meets in one place. Frames of rows are cut into chunks that bring copies of the rows before them.

Give a total order: rows that tie stand in any order. Scanned tables are written to the shared folder, so what a range
hands on belongs to the rows that are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

_IN_PART = (1 << 33) - 1


def _name(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numbered(df: DataFrame, order: list, name: str = "row") -> DataFrame:
    """df with the place of each row in the order, from 1."""
    whole = df.repartitionByRange(*map(_name, order)).sortWithinPartitions(*map(_name, order)).withColumn("__id", F.monotonically_increasing_id())
    whole = whole.withColumn("__part", F.shiftright("__id", 33).cast("int")).withColumn("__row", F.col("__id").bitwiseAND(F.lit(_IN_PART))).drop("__id")
    whole, upto, offsets = written(whole), 0, []
    for part, n in sorted(map(tuple, whole.groupBy("__part").count().collect())):
        offsets.append((part, upto))
        upto += n
    offsets = df.sparkSession.createDataFrame(offsets, "__part int, __before long")
    return whole.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__row") + 1).drop("__part", "__row", "__before")


def _filled(values: pa.Array, starts: np.ndarray) -> pa.Array:
    """The last known value up to each place, from the start of its group on."""
    known = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.arange(len(values)), -1)
    known = np.maximum.accumulate(known)
    return values.take(pa.array(known, mask=known < starts))


def _scan(by: list[str], sums: list[str], last: list[str]):
    """Rows of a part in their order, with sums and last values of the group (`by`) so far, and __open: whether the group was open before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, kept, before, is_open, at = {c: 0 for c in sums}, {c: None for c in last}, None, True, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = dict(zip(batch.schema.names, batch.columns))
            key = [column[c] for c in by]
            new = np.zeros(n, bool)
            for c in key:
                a, b = c.slice(1), c.slice(0, n - 1)
                same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
                new[1:] |= ~same
            new[0] = before is not None and [c[0].as_py() for c in key] != before
            starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            change = np.flatnonzero(new)
            carried = np.arange(n) < (change[0] if len(change) else n)  # rows of the group that the batch before left
            out = []
            for c in sums:
                x = pc.fill_null(column[c], 0).to_numpy(zero_copy_only=False)
                total = np.cumsum(x)
                own = total - (total - x)[starts] + np.where(carried, carry[c], 0)
                carry[c] = own[-1]
                out.append(pa.array(own, column[c].type))
            for c in last:
                own = _filled(column[c], starts)
                if kept[c] is not None and kept[c].is_valid:
                    own = pc.if_else(pa.array(carried & own.is_null().to_numpy(zero_copy_only=False)), kept[c], own)
                kept[c] = own[-1]
                out.append(own)
            opened = carried & is_open
            is_open = bool(opened[-1])
            before = [c[n - 1].as_py() for c in key]
            extra = {"__open": pa.array(opened), "__row": pa.array(np.arange(at, at + n))}
            at += n
            columns = [c for name, c in column.items() if name not in sums and name not in last]
            names = [name for name in column if name not in sums and name not in last]
            yield pa.RecordBatch.from_arrays([*columns, *out, *extra.values()], names=[*names, *sums, *last, *extra])

    return run


def scanned(df: DataFrame, order: list, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, by: tuple = ()) -> DataFrame:
    """df with running sums and last known values, in the order (by..., order...), each group of `by` on its own.

    sums: names and long or double columns, nulls count as 0, the row itself is in its sum. last: names and columns whose
    last non-null value up to the row is wanted. No group has to fit a task.
    """
    sums, last = sums or {}, last or {}
    full = [*map(F.col, by), *map(_name, order)]
    given = df.select("*", *[c.alias(n) for n, c in (sums | last).items()])
    dealt = given.repartitionByRange(*full).sortWithinPartitions(*full).withColumn("__part", F.spark_partition_id())
    names = [c for c in dealt.columns if c not in sums and c not in last]
    kinds = {f.name: f.dataType for f in dealt.schema.fields}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in [*names, *sums, *last]] + [T.StructField("__open", T.BooleanType()), T.StructField("__row", T.LongType())])
    whole = written(dealt.mapInArrow(_scan(list(by), list(sums), list(last)), schema))
    ends = F.max_by(F.struct(*by, *sums, *last, "__open"), "__row").alias("end")
    heads = F.min_by(F.struct(F.lit(0).alias("_"), *by), "__row").alias("head")
    parts = sorted(whole.groupBy("__part").agg(heads, ends).collect(), key=lambda r: r["__part"])
    handed, key = [], None
    nothing = {c: 0.0 if kinds[c] == T.DoubleType() else 0 for c in sums} | {c: None for c in last}
    carry = nothing
    for part in parts:
        head, end = [part["head"][c] for c in by], [part["end"][c] for c in by]
        goes_on = key is not None and head == key
        own = carry if goes_on else nothing
        handed.append((part["__part"], *own.values()))
        still = part["end"]["__open"]  # one group fills the part
        carry = {c: part["end"][c] + (own[c] if still else nothing[c]) for c in sums} | {c: own[c] if still and part["end"][c] is None else part["end"][c] for c in last}
        key = end
    fields = [T.StructField("__part", T.IntegerType())] + [T.StructField(f"__{c}", kinds[c]) for c in [*sums, *last]]
    handed = df.sparkSession.createDataFrame(handed, T.StructType(fields))
    out = whole.join(F.broadcast(handed), "__part")
    for c in sums:
        out = out.withColumn(c, F.col(c) + F.when(F.col("__open"), F.col(f"__{c}")).otherwise(F.lit(0).cast(kinds[c])))
    for c in last:
        out = out.withColumn(c, F.coalesce(c, F.when(F.col("__open"), F.col(f"__{c}"))))
    return out.drop("__part", "__row", "__open", *[f"__{c}" for c in [*sums, *last]])


def asof(left: DataFrame, right: DataFrame, at: str, since: str, values: list[str], by: tuple = (), following: bool = False, strict: bool = False, ties: list | None = None) -> DataFrame:
    """left with the values of right's last row of its group at or before `at` (strict: before); with following, of the first at or after.

    The two tables are put one under the other and scanned, so neither has to fit a task, nor any group of them. ties:
    columns of right that order its rows of one `since`; the last counts (following: the first).
    """
    ties = ties or []
    kinds = {f.name: f.dataType for f in right.schema.fields}
    of_right = F.struct(*values)
    one = left.withColumn("__at", F.col(at)).withColumn("__left", F.lit(True)).withColumn("__value", F.lit(None).cast(T.StructType([T.StructField(v, kinds[v]) for v in values])))
    for n, c in enumerate(ties):
        one = one.withColumn(f"__tie{n}", F.lit(None).cast(kinds[c]))
    two = right.select(*by, F.col(since).alias("__at"), F.lit(False).alias("__left"), of_right.alias("__value"), *[F.col(c).alias(f"__tie{n}") for n, c in enumerate(ties)])
    both = one.unionByName(two, allowMissingColumns=True)
    side = F.when(F.col("__left"), F.lit(0 if strict else 1)).otherwise(F.lit(1 if strict else 0))
    own = [f"__tie{n}" for n in range(len(ties))]
    order = [F.col("__at").desc() if following else F.col("__at"), side, *[F.col(c).desc() if following else F.col(c) for c in own]]
    both = both.withColumn("__flat", F.to_json("__value", {"ignoreNullFields": "false"})).withColumn("__flat", F.when(~F.col("__left"), F.col("__flat"))).drop("__value")
    found = scanned(both, order, last={"__known": F.col("__flat")}, by=by).where("__left")
    value = F.from_json("__known", T.StructType([T.StructField(v, kinds[v]) for v in values]))
    return found.withColumn("__value", value).select(*left.columns, *[F.col(f"__value.{v}").alias(v) for v in values])


# ---- frames of rows

#: Values of frames that are averaged at once.
FRAMES = 1 << 20


def _frames(window: int, chunk: int):
    """A chunk's own rows with low, high, mean, sd of the last `window` values; copies of earlier rows come first."""

    def extreme(x: np.ndarray, pick) -> np.ndarray:
        # blocks of a window: the extreme of a frame is that of one block's tail and the next one's head
        pad = np.inf if pick is np.minimum else -np.inf
        full = np.r_[np.full(window - 1, pad), x]
        full = np.r_[full, np.full(-len(full) % window, pad)].reshape(-1, window)
        head = pick.accumulate(full, axis=1).ravel()
        tail = pick.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        return pick(tail[: len(x)], head[window - 1 : window - 1 + len(x)])

    def of_chunk(part: pa.Table) -> list[pa.RecordBatch]:
        x = part.column("__value").to_numpy()
        mean, sd = np.empty(len(x)), np.empty(len(x))
        short = min(len(x), window - 1)  # frames at the table's start; a chunk's copies have them too, and go
        for i in range(short):
            mean[i], sd[i] = x[: i + 1].mean(), x[: i + 1].std()
        step = max(1, FRAMES // window)
        for i in range(short, len(x), step):
            frames = np.lib.stride_tricks.sliding_window_view(x[i - window + 1 : i + step], window)
            mean[i : i + step], sd[i : i + step] = frames.mean(axis=1), frames.std(axis=1)
        found = {"low": extreme(x, np.minimum), "high": extreme(x, np.maximum), "mean": mean, "sd": sd}
        for name, column in found.items():
            part = part.append_column(name, pa.array(column))
        own = part.column("__n").to_numpy() > part.column("__chunk")[0].as_py() * chunk  # rows from 1
        return part.filter(pa.array(own)).drop_columns(["__n", "__chunk", "__value"]).combine_chunks().to_batches()

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            numbers = part.column("__chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield from of_chunk(part.slice(a, b - a))
            rest = part.slice(cuts[-1])
        if rest is not None:
            yield from of_chunk(rest)

    return run


def sliding(df: DataFrame, order: list, value: str, window: int, chunk: int = 1 << 16) -> DataFrame:
    """df, without rows of no value, with low, high, mean and sd of `value` over the last `window` rows of the whole order.

    A chunk of rows is worked on in one go, with copies of the window - 1 rows before it; minima and maxima take two
    looks a row whatever the window.
    """
    chunk = max(chunk, window)
    rows = numbered(df.where(F.col(value).isNotNull()), order, "__n")
    own = F.floor((F.col("__n") - 1) / chunk)
    late = (F.col("__n") - 1) % chunk >= chunk - window + 1
    copies = rows.select("*", F.col(value).cast("double").alias("__value"), F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("__chunk"))
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("low", "high", "mean", "sd"))])
    return copies.repartition("__chunk").sortWithinPartitions("__chunk", "__n").mapInArrow(_frames(window, chunk), schema)


# ---- ranks


#: Cells of a histogram of one group.
CELLS = 2048


def nth_value(df: DataFrame, value: str, rank, by: tuple = ()) -> DataFrame:
    """by..., the value at a rank from 0, and how many rows are below and at it.

    rank: a function of the number of rows of a group. Two histograms narrow each group to the cell of a cell that holds
    the rank; only that cell's distinct values are put in order. Nulls do not count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    todo = rows.groupBy(*by).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("__n"))
    todo = todo.withColumn("__rank", rank(F.col("__n")).cast("long")).where("__rank >= 0 AND __rank < __n").drop("__n")
    return _selected(rows, todo, by).select(*by, F.col("__v").alias(value), F.col("__below").alias("below"), F.col("__c").alias("at"))


def _selected(rows: DataFrame, todo: DataFrame, by: tuple) -> DataFrame:
    """by..., __v, __below, __c of the value at a rank. rows: by..., __v; todo: by..., __low, __high, __rank."""
    todo = todo.withColumn("__below", F.lit(0).cast("long"))
    until = Window.unboundedPreceding, 0
    for _ in range(2):
        todo = written(todo)
        low = F.col("__low").cast("double")
        width = F.col("__high").cast("double") - low
        cell = F.when(width > 0, F.least(F.lit(CELLS - 1), F.floor((F.col("__v").cast("double") - low) / width * CELLS))).otherwise(F.lit(0)).cast("int")
        cells = _inside(rows, todo, by).groupBy(*by, cell.alias("__cell")).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("__c"))
        cells = cells.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*by).orderBy("__cell").rowsBetween(*until)))  # CELLS rows of a group
        todo = _crossing(_beside(cells, todo.drop("__low", "__high"), by)).select(*by, "__low", "__high", "__rank", "__below")
    todo = written(todo)
    values = _inside(rows, todo, by).groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    values = values.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*by).orderBy("__v").rowsBetween(*until)))
    return _crossing(_beside(values, todo, by)).select(*by, "__v", "__below", "__c")


def _inside(rows: DataFrame, todo: DataFrame, by: tuple) -> DataFrame:
    return _beside(rows, todo, by).where((F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high")))


def _crossing(counts: DataFrame) -> DataFrame:
    """The row of running counts in which the rank falls, with the number of all rows below it."""
    counts = counts.withColumn("__below", F.col("__below") + F.col("__upto") - F.col("__c"))
    return counts.where((F.col("__below") <= F.col("__rank")) & (F.col("__below") + F.col("__c") > F.col("__rank")))


def _beside(rows: DataFrame, per_group: DataFrame, by: tuple) -> DataFrame:
    return rows.join(per_group, list(by)) if by else rows.join(F.broadcast(per_group), F.lit(True))  # without groups one row


def first_rows(df: DataFrame, n: Column, order: list[str], by: tuple = ()) -> DataFrame:
    """The first n rows of each group in a total order of number columns; n: a column that is the same in all of a group.

    Each column is cut at the value where the n-th row stands; only rows that tie there go on to the next column. So no
    group is sorted. Rows with a null in the order are not among the first.
    """
    left = written(df.dropna(subset=order).withColumn("__want", n.cast("long")).where("__want > 0"))
    found = None
    for c in order:
        rows = left.select(*by, F.col(c).alias("__v"))
        ranks = left.groupBy(*by).agg(F.min(c).alias("__low"), F.max(c).alias("__high"), (F.least(F.first("__want"), F.count(F.lit(1))) - 1).alias("__rank"))
        cut = _selected(rows, ranks, by).select(*by, F.col("__v").alias("__cut"), "__below", "__c")
        beside = written(_beside(left, cut, by).where(F.col(c) <= F.col("__cut")))
        all_in = (F.col(c) < F.col("__cut")) | (F.col("__below") + F.col("__c") <= F.col("__want"))
        done = beside.where(all_in).select(*df.columns)
        found = done if found is None else found.unionByName(done)
        left = beside.where(~all_in).withColumn("__want", F.col("__want") - F.col("__below")).drop("__cut", "__below", "__c")
    return found
