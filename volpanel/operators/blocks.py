"""Ordered series in blocks: running sums, ranks and folds that no single task has to walk through.

A series is cut into blocks of its order (a span of days, or a range found by Spark's range partitioner). What a block
does to the state before it is written down as one row: a sum, or a table "state in, state out". Those rows are few -
one for each block - and are combined in order; then every block is filled in by itself from the state it starts with.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.functions.num import add
from volpanel.session import durable

#: Days, seconds or units of the order in one block.
SPAN = 512


def block_of(df: DataFrame, order: str, span: int = SPAN) -> str:
    """SQL: number of the block that a row's order falls into; a null order has block 0."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        number = f"unix_date({order})"
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = f"datediff({order}, DATE'1970-01-01')"
    else:
        number = order
    return f"bigint(coalesce(floor({number} / {span}), 0))"


def _over(*keys: str, order: str) -> str:
    return f"(PARTITION BY {', '.join(keys)} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" if keys else (
        f"(ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null; the columns of ``left`` and what ``right`` adds."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.expr(" AND ".join(f"{k} <=> _r_{k}" for k in keys))
    return left.join(named, same, "left").drop(*[f"_r_{k}" for k in keys])


def ranges(df: DataFrame, keys: Sequence[str], order: str, out: str = "_block", parts: int | None = None) -> DataFrame:
    """The rows with the number of their range; ranges follow (keys, order), and equal orders are never parted."""
    by = [*keys, order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    # sampled bounds must not change between the uses of the number
    return durable(dealt.withColumn(out, F.spark_partition_id().cast("long")))


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], *, block: str = "_block") -> DataFrame:
    """Sums over all rows of a key up to the current one, for rows with a block number; unique per (keys, order).

    Windows hold one block, or one row for each block.
    """
    keys, names = list(keys), list(sums)
    staged = add(df, {f"_v_{n}": e for n, e in sums.items()})
    inside = add(staged, {f"_s_{n}": f"sum(_v_{n}) OVER {_over(*keys, block, order=order)}" for n in names})
    totals = staged.groupBy(*keys, block).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = {f"_b_{n}": f"coalesce(sum(_t_{n}) OVER {_over(*keys, order=block)}, 0) - coalesce(_t_{n}, 0)" for n in names}
    before_rows = add(totals, before).select(*keys, block, *before)
    out = add(joined(inside, before_rows, [*keys, block]), {n: f"coalesce(_s_{n}, 0) + coalesce(_b_{n}, 0)" for n in names})
    return out.drop(*[f"_{p}_{n}" for n in names for p in "vsb"])


def positions(df: DataFrame, keys: Sequence[str], order: str, out: str, *, span: int = SPAN) -> DataFrame:
    """Row number from 0 in the order of each key; rows are unique per (keys, order)."""
    placed = running_sums(add(df, {"_block": block_of(df, order, span)}), keys, order, {out: "1L"})
    return add(placed, {out: f"{out} - 1L"}).drop("_block")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, *, parts: int | None = None) -> DataFrame:
    """(keys, value, out): the average rank from 1 of each distinct value of a key; null values have none.

    Rows are first counted per value, so a value that holds most of the rows is one row here.
    """
    sizes = df.filter(f"{value} IS NOT NULL").groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = running_sums(ranges(sizes, keys, value, parts=parts), keys, value, {"_up_to": "_n"})
    return add(placed, {out: "_up_to - (_n - 1) / 2D"}).select(*keys, value, out)


# ---- folds ----------------------------------------------------------------------


def fold_rows(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: T.StructType,
    *,
    keys: Sequence[str],
    order: str,
    start: Any,
    table: Callable[[pd.DataFrame], Any],
    enter: Callable[[Any, Any], Any],
    fill: Callable[[pd.DataFrame, Any], pd.DataFrame],
    span: int = SPAN,
) -> DataFrame:
    """(keys, order, outputs): what a recursion over the rows of each key yields, block by block.

    ``table(block)`` is what the block does to any state, ``enter(state, table)`` the state after it, and
    ``fill(block, state)`` the output columns of its rows. Tables and states are kept as JSON. Only keys, order and
    inputs go through Python; rows are unique per (keys, order).
    """
    keys = list(keys)
    narrow = add(df.select(*keys, order, *[c for c in inputs if c not in (*keys, order)]), {"_block": block_of(df, order, span)})
    narrow = durable(narrow)  # read three times
    own = [narrow.schema[k] for k in keys]
    numbered = [*own, T.StructField("_block", T.LongType())]

    def first(pdf: pd.DataFrame) -> list:
        return [pdf[k].iloc[0] for k in (*keys, "_block")]

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        text = json.dumps(table(pdf.sort_values(order, kind="stable")))
        return pd.DataFrame([[*first(pdf), text]], columns=[*keys, "_block", "_table"])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        state, found = start, []
        for text in pdf["_table"]:
            found.append(json.dumps(state))
            state = enter(state, json.loads(text))
        return pdf[[*keys, "_block"]].assign(_state=found)

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        out = fill(pdf, json.loads(pdf["_state"].iloc[0]))
        return pd.concat([pdf[[*keys, order]], out], axis=1)

    text = lambda name: T.StructField(name, T.StringType())
    made = narrow.groupBy(*keys, "_block").applyInPandas(tables, T.StructType([*numbered, text("_table")]))
    met = made.groupBy(*keys).applyInPandas(states, T.StructType([*numbered, text("_state")]))
    rows = joined(narrow, met, [*keys, "_block"])
    return rows.groupBy(*keys, "_block").applyInPandas(filled, T.StructType([*own, narrow.schema[order], *outputs.fields]))


def fold(df: DataFrame, inputs: Sequence[str], outputs: T.StructType, *, keys: Sequence[str], order: str, **how: Any) -> DataFrame:
    """The rows with what ``fold_rows`` yields for them."""
    return joined(df, fold_rows(df, inputs, outputs, keys=keys, order=order, **how), [*keys, order])
