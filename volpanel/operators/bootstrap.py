"""Bootstraps: a table of draws, and statistics of the draws by array look-ups.

A table of draws has one row per key and replicate with the picks of that replicate (positions from 0). It comes from
numpy's seeded generator (``seeded``) or from integer arithmetic on (seed, replicate, slot) (``counted``), which any
engine can repeat. Statistics read prefix sums or sums per cluster, so a replicate never copies rows of the sample.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from volpanel.functions.num import add

#: (sizes, keys, replicates) -> (keys, replicate, picks); sizes has n (positions), slots (picks of a replicate) and seed.
Draws = Callable[[DataFrame, Sequence[str], int], DataFrame]

HALF = 2**31


def pick(seed: str, replicate: str, slot: str, n: str, xor: str = "({0} ^ {1})") -> str:
    """SQL: a position below ``n``, spread by two rounds of multiplication and folding of 31-bit numbers."""
    h = f"(({seed} + {replicate} * 1000003 + {slot} * 7919) * 1540483477 % {HALF})"
    for factor, shift in ((1812433253, 2**15), (1566083941, 2**13)):
        folded = xor.format(h, f"CAST(floor({h} / {shift}) AS BIGINT)")
        h = f"({folded} * {factor} % {HALF})"
    return f"CAST(floor({h} / 64) AS BIGINT) % {n}"


def counted(sizes: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    rows = add(sizes, {"replicate": f"explode(sequence(0L, {replicates - 1}L))"})
    return rows.selectExpr(*keys, "replicate", f"transform(sequence(0L, bigint(slots) - 1L), j -> {pick('bigint(seed)', 'replicate', 'j', 'n')}) AS picks")


def seeded(sizes: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """All replicates of a key are drawn at once, in the order of the generator."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        n, slots, seed = (int(pdf[c].iloc[0]) for c in ("n", "slots", "seed"))
        picks = np.random.default_rng(seed).integers(0, n, size=(replicates, slots))
        out = pd.DataFrame({"replicate": np.arange(replicates), "picks": list(picks)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "replicate", "picks"]]

    added = [T.StructField("replicate", T.LongType()), T.StructField("picks", T.ArrayType(T.LongType()))]
    return sizes.groupBy(*keys).applyInPandas(draw, T.StructType([*(sizes.schema[k] for k in keys), *added]))


def total(values: str) -> str:
    """SQL: sum of the values of a pick ``i`` over all picks."""
    return f"aggregate(picks, 0D, (a, i) -> a + {values})"


def running(values: str) -> str:
    """SQL: array of prefix sums of an array of doubles; element k is the sum of the first k."""
    step = "struct(array_append(a.out, a.at + x) AS out, a.at + x AS at)"
    return f"aggregate({values}, struct(array(0D) AS out, 0D AS at), (a, x) -> {step}, a -> a.out)"
