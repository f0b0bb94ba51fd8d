"""Order-dependent columns per key that survive a hot key.

``lag`` or ``last`` over ``partitionBy(key)`` puts a key's whole history into one task. Here
the history is cut into time slices: every ``(key, slice)`` is a separate task-sized group,
and what a slice needs from earlier ones is a short summary.

1. Each slice is summarised by a partial aggregation (its last row, last non-null value, or
   row count), so the shuffle carries one row per slice and map task.
2. A window over the summaries alone gives each slice what precedes it. A key has
   ``span / width`` of these, however many rows it has.
3. What precedes a slice is put in front of its rows as one more row, and the window runs inside
   the slice. There is no join, so no row is lost: null keys form a key of their own, and rows
   without a time keep null history columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.columns import order_key

SLICE = "_slice"
DEFAULT_SLICE_US = 60_000_000


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str | None = None,
    *,
    previous: dict[str, Sequence[str]] | None = None,
    carried: dict[str, str] | None = None,
    before: dict[str, str] | None = None,
    position: str | None = None,
    width: int = DEFAULT_SLICE_US,
) -> DataFrame:
    """Add history columns, ordered by ``(at, tie)`` within ``keys``.

    ``previous``  name -> fields of the row before, as a struct (null for the first row)
    ``carried``   name -> column whose last non-null value up to and including this row is kept
    ``before``    name -> column whose last non-null value strictly before this row is kept
    ``position``  name of a 1-based row number
    ``width``     length of a slice, in units of the integer column ``at``
    """
    previous, carried, before = previous or {}, carried or {}, before or {}
    order = [at] if tie is None else [at, tie]
    key = order_key(*order)

    summaries: list[Column] = []
    for name, fields in previous.items():
        summaries += [F.max_by(f, key).alias(f"_{name}_{f}") for f in fields]
    for name, source in {**carried, **before}.items():
        summaries.append(F.max_by(source, F.when(F.col(source).isNotNull(), key)).alias(f"_{name}"))
    if position:
        summaries.append(F.count(F.lit(1)).alias("_rows"))

    sliced = df.withColumn(SLICE, F.expr(f"`{at}` div {width}"))
    summary = sliced.filter(F.col(at).isNotNull()).groupBy(*keys, SLICE).agg(*summaries)

    earlier = Window.partitionBy(*keys).orderBy(SLICE)
    earlier_all = earlier.rowsBetween(Window.unboundedPreceding, -1)
    entering: list[Column] = []
    for name, fields in previous.items():
        # lag of the struct, so that a null field of the last row is not mistaken for "no row"
        tail = F.struct(*[F.col(f"_{name}_{f}").alias(f) for f in fields])
        entering.append(F.lag(tail).over(earlier).alias(f"_{name}"))
    for name in {**carried, **before}:
        entering.append(F.last(f"_{name}", ignorenulls=True).over(earlier_all).alias(f"_{name}"))
    if position:
        entering.append(F.coalesce(F.sum("_rows").over(earlier_all), F.lit(0)).alias("_rows"))
    first = summary.select(*keys, SLICE, F.struct(*entering).alias("_entering"), F.lit(0).alias("_row"))
    stacked = sliced.withColumn("_row", F.lit(1)).unionByName(first, allowMissingColumns=True)

    inside = Window.partitionBy(*keys, SLICE).orderBy("_row", *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    strictly = inside.rowsBetween(Window.unboundedPreceding, -1)
    entered = F.first("_entering").over(upto)
    added: list[Column] = []
    for name, fields in previous.items():
        in_slice = F.when(F.lag("_row").over(inside) == 1, F.lag(F.struct(*fields)).over(inside))
        added.append(F.coalesce(in_slice, entered[f"_{name}"]).alias(name))
    for name, source in carried.items():
        added.append(F.coalesce(F.last(source, ignorenulls=True).over(upto), entered[f"_{name}"]).alias(name))
    for name, source in before.items():
        added.append(F.coalesce(F.last(source, ignorenulls=True).over(strictly), entered[f"_{name}"]).alias(name))
    if position:
        added.append((F.row_number().over(inside) - 1 + entered["_rows"]).cast("bigint").alias(position))
    names = [*previous, *carried, *before, *([position] if position else [])]
    timed = [F.when(F.col(at).isNotNull(), c).alias(name) for name, c in zip(names, added)]
    kept = [c for c in df.columns if c not in names]
    history = stacked.select(*[F.col(f"`{c}`") for c in kept], "_row", *timed).filter("_row = 1")
    return history.select(*[F.col(f"`{c}`") for c in kept], *names)


def with_previous(
    df: DataFrame, keys: Sequence[str], at: str, tie: str | None, fields: Sequence[str],
    name: str = "prev", width: int = DEFAULT_SLICE_US,
) -> DataFrame:
    return with_history(df, keys, at, tie, previous={name: fields}, width=width)


def rolling_lag(
    df: DataFrame, keys: Sequence[str], at: str, tie: str | None, value: str, n: int,
    name: str, position: str, width: int = DEFAULT_SLICE_US, block: int = 100_000,
) -> DataFrame:
    """Add ``value`` of the row ``n`` places earlier, or of the key's first row if there are fewer.

    Rows are numbered per key, then cut into blocks of equal size; the last ``n`` rows of a
    block are repeated in the next one, so that each block is complete on its own.
    """
    numbered = with_history(df, keys, at, tie, position=position, width=width)
    home = F.floor((F.col(position) - 1) / F.lit(block)).cast("bigint")
    in_tail = F.pmod(F.col(position) - 1, F.lit(block)) >= block - n
    blocks = F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))  # one null where there is no position
    # Rows without a time have no position; they form a block of their own.
    spread = numbered.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    inside = Window.partitionBy(*keys, "_block").orderBy(position)
    lagged = F.when(F.col(position).isNotNull(), F.first(value).over(inside.rowsBetween(-n, 0)))
    return (
        spread.withColumn(name, lagged)
        .filter(F.col("_home").eqNullSafe(F.col("_block")))
        .drop("_home", "_block")
    )
