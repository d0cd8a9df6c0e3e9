"""Windows and ordered folds over keyed daily series.

A series row is unique per (keys, order) with a session date as the order, so a
window partition holds at most one row per calendar day: its size is bounded by
the calendar however large the raw tables are. Raw rows are always aggregated
to that grain (with map-side partial sums) before any window is opened.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from volpanel import params as P
from volpanel.functions.num import add, known, log_ratio
from volpanel.operators import blocks as B


def by(keys: Sequence[str], order: str | Sequence[str]) -> str:
    """Partition and order clause of a window."""
    orders = order if isinstance(order, str) else ", ".join(order)
    return (f"PARTITION BY {', '.join(keys)} " if keys else "") + f"ORDER BY {orders}"


def lag(value: str, over: str, rows: int = 1) -> str:
    return f"lag({value}, {rows}) OVER ({over})"


# ---- returns and differences ----------------------------------------------


def log_return(value: str, over: str, rows: int = 1) -> str:
    return log_ratio(value, lag(value, over, rows))


def difference(value: str, over: str, rows: int = 5) -> str:
    return f"({value} - {lag(value, over, rows)})"


def percent_change(value: str, over: str, first: str = "0D") -> str:
    return f"coalesce(try_divide({value}, {lag(value, over)}) - 1D, {first})"


def drawdown(value: str, over: str) -> str:
    peak = f"max({value}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"(try_divide({value}, {peak}) - 1D)"


def compounded_return(returns: str, over: str, rows: int = 20) -> str:
    """Compounded return of a full frame of ``rows`` rows, NULL while it fills.

    The product runs through logarithms; zero and negative factors are counted
    apart because they have none.
    """
    frame = f"OVER ({over} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    factor = f"(1D + {returns})"
    logs = f"sum(CASE WHEN {factor} <> 0 THEN ln(abs({factor})) ELSE 0D END) {frame}"
    sign = f"(CASE WHEN count_if({factor} < 0) {frame} % 2 = 1 THEN -1D ELSE 1D END)"
    product = f"(CASE WHEN count_if({factor} = 0) {frame} > 0 THEN 0D ELSE {sign} * exp({logs}) END)"
    return f"(CASE WHEN count({returns}) {frame} = {rows} THEN {product} - 1D END)"


def position(over: str) -> str:
    return f"(row_number() OVER ({over}) - 1L)"


# ---- rolling mid-rank percentile --------------------------------------------


def _midrank(values: np.ndarray, first: int, reference: int, minimum: int) -> np.ndarray:
    """Mid-rank of values[first:] among the ``reference`` rows before each."""
    padded = np.concatenate([np.full(reference, np.nan), values])
    windows = np.lib.stride_tricks.sliding_window_view(padded, reference)[first : len(values)]
    current = values[first:, None]
    valid = np.count_nonzero(~np.isnan(windows), axis=1)
    below = np.count_nonzero(windows < current, axis=1)
    equal = np.count_nonzero(windows == current, axis=1)
    with np.errstate(all="ignore"):
        ranks = (below + 0.5 * equal) / valid
    return np.where((valid >= minimum) & ~np.isnan(values[first:]), ranks, np.nan)


def midrank_percentiles(
    df: DataFrame,
    columns: Mapping[str, tuple[str, int]],
    *,
    keys: Sequence[str] = ("economic_index_id",),
    order: str = "session_date",
    reference: int = P.REFERENCE_SESSIONS,
    minimum_valid: int = P.MINIMUM_VALID,
    block: int = 2048,
) -> DataFrame:
    """Point-in-time percentile of signed columns among the preceding rows.

    The frame is fixed first (``reference`` rows before the current one) and
    invalid rows are dropped inside it afterwards. A long series is split into
    blocks; each block also receives the ``reference`` rows before it, so every
    block is an independent task and no series has to fit in one.
    """
    block = max(block, reference)
    keys = list(keys)
    numbered = add(df, {"_pos": position(by(keys, order))})
    blocks = f"explode(sequence(_pos div {block}, (_pos + {reference}) div {block}))"
    spread = add(numbered, {"_block": blocks})
    schema = T.StructType(
        list(df.schema.fields) + [T.StructField(name, T.DoubleType()) for name in columns]
    )
    plan = dict(columns)
    names = list(schema.names)

    def rank_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", kind="stable")
        number = int(pdf["_block"].iloc[0])
        first = int(np.searchsorted(pdf["_pos"].to_numpy(), number * block))
        out = pdf.iloc[first:].copy()
        for name, (source, sign) in plan.items():
            values = pdf[source].to_numpy(dtype=float, na_value=np.nan)
            values = sign * np.where(np.isfinite(values), values, np.nan)
            ranks = _midrank(values, first, reference, minimum_valid)
            out[name] = pd.Series(ranks, index=out.index).astype(object).where(~np.isnan(ranks), None)
        return out[names]

    # A block past the end of a series would hold history only and yield nothing.
    return spread.groupBy(*keys, "_block").applyInPandas(rank_block, schema)


# ---- dispersion of recent valid changes --------------------------------------


def vol_of_vol(
    df: DataFrame,
    source: str,
    out: str,
    span_out: str,
    *,
    keys: Sequence[str],
    order: str,
    count: int = P.VOV_COUNT,
    max_span: int = P.VOV_SPAN_SESSIONS,
) -> DataFrame:
    """Annualised deviation of the last ``count`` valid values inside ``max_span`` rows.

    Valid rows form their own sub-partition, so "the last 20 valid" is a plain
    20-row frame and the span is a difference of row positions.
    """
    staged = add(df, {"_pos": position(by(keys, order)), "_x": known(source)})
    staged = add(staged, {"_ok": "_x IS NOT NULL"})
    over = by([*keys, "_ok"], order)
    span = f"(_pos - {lag('_pos', over, count - 1)} + 1)"
    deviation = f"stddev_samp(_x) OVER ({over} ROWS BETWEEN {count - 1} PRECEDING AND CURRENT ROW)"
    usable = f"_ok AND {span} <= {max_span}"
    return add(
        staged,
        {
            out: f"CASE WHEN {usable} THEN {deviation} * sqrt({P.SESSIONS_PER_YEAR}D) END",
            span_out: f"CASE WHEN {usable} THEN {span} END",
        },
    ).drop("_pos", "_x", "_ok")


# ---- exponentially weighted variance -----------------------------------------


class Ewma:
    """The variance recursion over blocks: an unbroken run of returns is the map level -> a * level + b."""

    def __init__(self, returns: str, out: str, decay: float, warmup: int):
        self.returns, self.out, self.decay, self.warmup = returns, out, decay, warmup

    def affine(self, x: np.ndarray) -> tuple[float, float]:
        """(a, b) of the returns, in their order."""
        weights = self.decay ** np.arange(len(x) - 1, -1, -1, dtype=float)
        return float(self.decay ** len(x)), float((1.0 - self.decay) * (weights * x * x).sum())

    def follow(self, state: dict, size: int, b: float, head: np.ndarray) -> dict:
        """The state after ``size`` more returns, of which ``head`` are the first (``warmup`` of them, if there are)."""
        if "level" in state:
            return {"level": self.decay**size * state["level"] + b}
        seen = state["values"]
        missing = self.warmup - len(seen)
        if size < missing:
            return {"values": [*seen, *head[:size].tolist()]}
        seed = float(np.var([*seen, *head[:missing]], ddof=1))
        # what the returns up to the seed have added to b decays by those behind it
        rest = self.decay ** (size - missing)
        return {"level": rest * seed + b - rest * self.affine(head[:missing])[1]}

    def table(self, pdf: pd.DataFrame) -> dict:
        x = pdf[self.returns].to_numpy(dtype=float, na_value=np.nan)
        breaks = np.flatnonzero(~np.isfinite(x))
        first = x[: breaks[0]] if len(breaks) else x
        out = {"size": len(first), "b": self.affine(first)[1], "head": first[: self.warmup].tolist()}
        if len(breaks):
            last = x[breaks[-1] + 1 :]
            out["anew"] = self.follow({"values": []}, len(last), self.affine(last)[1], last[: self.warmup])
        return out

    def enter(self, state: dict, table: dict) -> dict:
        return table["anew"] if "anew" in table else self.follow(state, table["size"], table["b"], np.array(table["head"]))

    def fill(self, pdf: pd.DataFrame, state: dict) -> pd.DataFrame:
        x = pdf[self.returns].to_numpy(dtype=float, na_value=np.nan)
        level, seen, result = state.get("level"), list(state.get("values", [])), []
        for value in x:
            if not np.isfinite(value):
                level, seen = None, []
            elif level is not None:
                level = self.decay * level + (1.0 - self.decay) * value * value
            else:
                seen.append(value)
                if len(seen) == self.warmup:
                    level = float(np.var(seen, ddof=1))
            result.append(level)
        return pd.DataFrame({self.out: pd.Series(result, dtype=object)})


def ewma_variance(
    df: DataFrame,
    returns: str,
    out: str,
    *,
    keys: Sequence[str],
    order: str,
    decay: float = P.EWMA_DECAY,
    warmup: int = P.EWMA_WARMUP,
    span: int = B.SPAN,
) -> DataFrame:
    """Variance recursion seeded by the sample variance of ``warmup`` unbroken returns; a missing return clears it
    and the warm-up starts again. Blocks of a series are worked on at the same time."""
    run = Ewma(returns, out, decay, warmup)
    schema = T.StructType([T.StructField(out, T.DoubleType())])
    return B.fold(
        df, [returns], schema, keys=keys, order=order, start={"values": []}, table=run.table, enter=run.enter, fill=run.fill, span=span
    )
