"""Ordered computations that survive hot keys.

A window over one key sorts all rows of that key in one task.  The helpers here cut every key into blocks of its
ordering column first.  Rows are shuffled once, by (key, block); block summaries are taken from that exchange, chained per
key over the few summary rows, and joined to a window that is local to (key, block).  The block expression must be monotone
in the ordering, for example ``position div 65536`` or a prefix of a hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 65536
# Hex digits of a digest that name a block: 16 ** 4 blocks of a key.
BLOCK_DIGITS = 4
# Blocks without a key are chained in groups of this many.
GROUP_BLOCKS = 4096
BLOCK = "_block"


def position_block(position: Column | str, rows: int = BLOCK_ROWS) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(rows)).cast("bigint")


def hash_block(digest: Column | str, digits: int = BLOCK_DIGITS) -> Column:
    """16**digits equal blocks of a hex digest."""
    return F.substring(digest, 1, digits)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key.  Catalyst limits each map task to one row per key before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def _touched(df: DataFrame) -> Column:
    """A number for which every column of a row is needed, computed without reading long values."""

    def part(field: T.StructField) -> Column:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(column)
        text = kind.simpleString()
        return column.isNull() if "map<" in text or "variant" in text else column

    return F.xxhash64(*[part(field) for field in df.schema])


def _combined(kind: str, a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b) if kind == "sum" else F.greatest(a, b)


def _carried(blocks: DataFrame, key: str, block: str, kinds: Sequence[str], n: int) -> DataFrame:
    """``_c0``, ...: what all earlier blocks of the key add up to, for the first ``n`` totals; of the others, the whole key's."""
    whole = Window.partitionBy(key)
    earlier = whole.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("*", *[getattr(F, kind)(f"_scan_t{i}").over(earlier if i < n else whole).alias(f"_scan_c{i}")
                                for i, kind in enumerate(kinds)])


def _carried_in_groups(blocks: DataFrame, kinds: Sequence[str], n: int) -> DataFrame:
    """The same without a key: groups of blocks are chained, and the blocks within each group."""
    grouped = blocks.withColumn("_scan_group", F.struct(F.floor(F.col("_scan_b") / GROUP_BLOCKS).alias("g")))
    groups = grouped.groupBy("_scan_group", "_scan_key").agg(*[getattr(F, kind)(f"_scan_t{i}").alias(f"_scan_t{i}") for i, kind in enumerate(kinds)])
    outer = _carried(groups, "_scan_key", "_scan_group", kinds, n).select(F.col("_scan_group").alias("_scan_in"), *[
        F.col(f"_scan_c{i}").alias(f"_scan_o{i}") for i in range(len(kinds))])
    inner = _carried(grouped, "_scan_group", "_scan_b", kinds, n).join(outer, F.col("_scan_group") == F.col("_scan_in"))
    return inner.withColumns({f"_scan_c{i}": _combined(kind, F.col(f"_scan_o{i}"), F.col(f"_scan_c{i}")) if i < n else F.col(f"_scan_o{i}")
                              for i, kind in enumerate(kinds)})


def scanned(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column],
            running: dict[str, tuple[Column, str, int]], totals: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Adds running and total values of each key; keys may be NULL.

    ``running``: name -> (value, "sum" or "max", until), over all rows of the key up to ``until`` (0: this row, -1: the one
    before) in the given order; NULL while there is no value.  ``totals``: name -> (value, aggregate), over the whole key.

    Rows are shuffled once, by key and block.  Summaries of blocks are taken from that same exchange, so ``df`` is evaluated
    once; what earlier blocks add up to is joined to each block.  The exchange serves both uses only if both ask for the same
    columns, hence ``_touched``.  All columns of ``df`` are shuffled: select what is needed before.
    """
    totals = totals or {}
    kinds = [kind for _, kind, *_ in running.values()] + [kind for _, kind in totals.values()]
    values = [v for v, *_ in running.values()] + [v for v, _ in totals.values()]
    n = len(running)
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("k"))
    cells = df.select("*", F.struct(key.alias("key"), block.alias("b")).alias("_scan_cell"), *[
        v.alias(f"_scan_v{i}") for i, v in enumerate(values)]).repartition("_scan_cell")
    touched = _touched(cells)
    blocks = cells.groupBy("_scan_cell").agg(F.max(touched).alias("_scan_touched"), *[
        getattr(F, kind)(f"_scan_v{i}").alias(f"_scan_t{i}") for i, kind in enumerate(kinds)])
    carried = blocks.select(F.col("_scan_cell").alias("_scan_at"), "_scan_touched", F.col("_scan_cell.key").alias("_scan_key"), F.col("_scan_cell.b").alias("_scan_b"),
                            *[f"_scan_t{i}" for i in range(len(kinds))])
    # Without a key the number of blocks grows with the data, unless they come from a hash.
    growing = not keys and isinstance(blocks.schema["_scan_cell"].dataType["b"].dataType, (T.LongType, T.IntegerType))
    carried = _carried_in_groups(carried, kinds, n) if growing else _carried(carried, "_scan_key", "_scan_b", kinds, n)
    carried = carried.withColumnRenamed("_scan_touched", "_scan_most")
    out = cells.join(carried, (F.col("_scan_cell") == F.col("_scan_at")) & (touched <= F.col("_scan_most")))
    for i, (name, (_, kind, until)) in enumerate(running.items()):
        window = Window.partitionBy("_scan_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, until)
        out = out.withColumn(f"_scan_r{i}", getattr(F, kind)(f"_scan_v{i}").over(window))
        out = out.withColumn(f"_scan_r{i}", _combined(kind, F.col(f"_scan_r{i}"), F.col(f"_scan_c{i}")))
    return out.select(*[c for c in df.columns if c not in running and c not in totals],
                      *[F.col(f"_scan_r{i}").alias(name) for i, name in enumerate(running)],
                      *[F.col(f"_scan_c{i}").alias(name) for i, name in enumerate(totals, n)])


def numbered(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], name: str,
             total: str | None = None) -> DataFrame:
    """1-based row number within the key, in the given order; ``total`` adds the number of rows of the key."""
    one = F.lit(1).cast("bigint")
    return scanned(df, keys, block, order, {name: (one, "sum", 0)}, {total: (one, "sum")} if total else None)


def first_rows(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], n: int,
               name: str) -> DataFrame:
    """First ``n`` rows per key with their number.

    Of one row per key each map task hands on one at most; for more the key is numbered block by block.
    """
    if n == 1:
        return first_row(df, keys, order).withColumn(name, F.lit(1).cast("bigint"))
    ranked = numbered(df, keys, block, order, name)
    return ranked.where(F.col(name) <= n)


def sums_before(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column],
                values: dict[str, Column]) -> DataFrame:
    """Exclusive running sums within the key: what all earlier rows add up to (0 for the first)."""
    summed = scanned(df, keys, block, order, {name: (value, "sum", -1) for name, value in values.items()})
    return summed.withColumns({name: F.coalesce(name, F.lit(0)).cast("bigint") for name in values})


def sum_before(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], value: Column,
               name: str) -> DataFrame:
    """One sum of ``sums_before``."""
    return sums_before(df, keys, block, order, {name: value})


def max_so_far(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], value: Column,
               name: str) -> DataFrame:
    """Inclusive running maximum within the key; NULL while no value has been seen."""
    return scanned(df, keys, block, order, {name: (value, "max", 0)})


def with_totals(df: DataFrame, keys: Sequence[str], block: Column, totals: dict[str, tuple[Column, str]]) -> DataFrame:
    """Rows with aggregates over their key: name -> (value, aggregate that can be taken of its own results)."""
    return scanned(df, keys, block, [], {}, totals)


def preceding_values(df: DataFrame, keys: Sequence[str], position: str, value: Column, count: int, name: str,
                     rows: int = BLOCK_ROWS) -> DataFrame:
    """Values of the ``count`` rows before each row, oldest first.  ``position`` is dense within the key.

    The last ``count`` rows of a block are copied into the next one, so that blocks stay independent.
    """
    block = position_block(position, rows)
    offset = F.pmod(F.col(position), F.lit(rows))
    homes = F.when(offset >= rows - count, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = df.withColumn("_value", value).withColumn("_shift", F.explode(homes)).withColumn(
        BLOCK, block + F.col("_shift"))
    window = Window.partitionBy(*keys, BLOCK).orderBy(position).rowsBetween(-count, -1)
    return spread.withColumn(name, F.collect_list("_value").over(window)).where("_shift = 0").drop(
        "_value", "_shift", BLOCK)
