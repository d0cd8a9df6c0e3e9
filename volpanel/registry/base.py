"""How a query and its SQL check are registered.

``columns`` names the output: ``x`` is compared as it is, ``x#`` as a bigint,
``x~`` as a double rounded to 6 digits (``x~2`` to 2). Both sides are projected
by the same list. SQL checks are written against named steps (``STEPS``); the
steps a statement uses are put in front of it as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from volpanel.session import durable
from volpanel.sources.views import VIEWS, duck_view

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def shared(build: Run) -> Run:
    """A table that several queries read: built once per session and folder.

    It is materialised by a reliable checkpoint, as the end-to-end job writes
    its stage tables and reads them back.
    """

    def get(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder, f"{build.__module__}.{build.__name__}")
        if key not in _TABLES:
            _TABLES[key] = durable(build(spark, folder))
        return _TABLES[key]

    get.direct = build
    return get


STEPS: dict[str, str] = {f"v_{name}": duck_view(name) for name in VIEWS}
RECURSIVE: set[str] = set()


def step(name: str, text: str, recursive: bool = False) -> None:
    STEPS[name] = text
    if recursive:
        RECURSIVE.add(name)


def _parse(columns: str) -> list[tuple[str, str, int]]:
    parsed = []
    for word in columns.split():
        name, mark, digits = re.fullmatch(r"(\w+)([~#]?)(\d*)", word).groups()
        parsed.append((name, mark, int(digits or 6)))
    return parsed


def _spark_projection(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, mark, digits in _parse(columns):
        if mark == "#":
            out.append(f"bigint({name}) AS {name}")
        elif mark == "~":
            d = f"double({name})"
            out.append(
                f"CASE WHEN abs({d}) < 0.5e-{digits} THEN 0D "
                f"ELSE round({d} * 1e{digits}) / 1e{digits} END AS {name}"
            )
        else:
            out.append(name)
    return df.selectExpr(*out)


def _sql_projection(columns: str) -> str:
    out = []
    for name, mark, digits in _parse(columns):
        if mark == "#":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif mark == "~":
            d = f"CAST({name} AS DOUBLE)"
            out.append(
                f"CASE WHEN abs({d}) < 0.5e-{digits} THEN CAST(0 AS DOUBLE) "
                f"ELSE round({d} * 1e{digits}) / 1e{digits} END AS {name}"
            )
        else:
            out.append(name)
    return ", ".join(out)


def statement(select: str, columns: str | None = None) -> str:
    """The select with every step it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z]\w*\b", text)):
            if word in STEPS and word != own and word not in ordered:
                visit(STEPS[word], word)
                if word not in ordered:
                    ordered.append(word)

    visit(select, None)
    body = select if columns is None else f"SELECT {_sql_projection(columns)} FROM (\n{select}\n) final_rows"
    if not ordered:
        return body
    head = "WITH RECURSIVE" if any(s in RECURSIVE for s in ordered) else "WITH"
    parts = []
    for s in ordered:
        hint = "" if s in RECURSIVE else "MATERIALIZED "
        name = s if s not in RECURSIVE else s
        parts.append(f"{name} AS {hint}({STEPS[s]})")
    return f"{head} " + ",\n".join(parts) + f"\n{body}"


def register(name: str, columns: str, sql: str | None = None) -> Callable[[Run], Run]:
    def wrap(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def projected(spark: SparkSession, folder: str) -> DataFrame:
            return _spark_projection(run(spark, folder), columns)

        QUERIES[name] = Query(name, projected, statement(sql, columns) if sql is not None else None)
        return run

    return wrap
