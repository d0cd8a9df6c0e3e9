"""Sinks: parquet, CSV and JSON outputs, flattened states, table contract, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.functions.num import add
from volpanel.operators import calendar as C
from volpanel.operators.market import AXIS_NAMES, UNIVERSE

STATE_COLUMNS = (
    "session_date evidence_tier data_status confidence primary_phase raw_phase pressure_level direction pressure_score insurance_level "
    "shock down_tail up_tail persistence breadth repair level_answer shock_answer tail_answer term_answer breadth_answer repair_answer "
    "outlook_answer large_stressed mid_stressed tech_stressed stressed_segment_count stressed_index_count weighted_breadth_score "
    "hard_acute persistent_now repair_confirmed checkpoint_hash previous_checkpoint_hash"
).split()


def write_table(df: DataFrame, path: str, *, date: str = "session_date") -> None:
    """zstd parquet partitioned by year, so date filters prune folders."""
    rows = add(df, {"session_year": f"year({date})"})
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("session_year").parquet(path)


def write_ordered(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Parquet files that follow each other in the given order, each sorted; rows are dealt out by ranges."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def stored_order(spark: SparkSession, path: str, out: str = "position") -> DataFrame:
    """The rows of a table with their place from 1 over all its files, as they lie there."""
    rows = spark.read.parquet(path).selectExpr("*", "_metadata.file_name AS _file", "_metadata.row_index AS _row")
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = add(sizes, {"_before": "coalesce(sum(_n) OVER (ORDER BY _file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"})
    return add(rows.join(before.drop("_n"), "_file"), {out: "_before + _row + 1"}).drop("_file", "_row", "_before")


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], *, buckets: int = 200) -> DataFrame:
    """A table dealt into buckets of its keys and sorted by them; returns it as the catalog reads it.

    Two tables with equal keys and buckets are joined, and one is grouped by its keys, without an exchange.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def write_csv(df: DataFrame, path: str, *, order: Sequence[str] = ()) -> None:
    rows = df.sortWithinPartitions(*order) if order else df
    rows.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document per session, one per line, foldered by year.

    Rows of a year meet in one task before the write, so a folder holds one
    file and not one per upstream task.
    """
    rows = add(df, {"session_year": "year(session_date)"}).repartition("session_year")
    rows.sortWithinPartitions("session_date").write.mode("overwrite").partitionBy("session_year").json(path)


def latest(df: DataFrame, keys: Sequence[str] = (UNIVERSE,), order: str = "session_date") -> DataFrame:
    packed = f"max_by(struct(*), {order}) AS _row"
    return df.groupBy(*keys).agg(F.expr(packed)).select("_row.*")


def flatten_states(state: DataFrame) -> DataFrame:
    if "outlook_answer" not in state.columns:
        state = add(state, {"outlook_answer": "'UNKNOWN'"})
    return state.select(*([UNIVERSE] if UNIVERSE in state.columns else []), *STATE_COLUMNS)


def flatten_index_states(state: DataFrame) -> DataFrame:
    rows = state.select(UNIVERSE, "session_date", F.explode("economic_indices").alias("economic_index_id", "s"))
    return rows.selectExpr(
        UNIVERSE, "session_date", "economic_index_id", "s.source_carrier AS carrier_id", "s.data_status",
        *[f"s.{a} AS {a}" for a in AXIS_NAMES], "s.issues",
    )


def attach_contract(
    df: DataFrame, calendar: DataFrame, *, version_field: str, version: str, common: Mapping[str, str]
) -> DataFrame:
    """Version, provenance, decision time (next session's opening) and an unknown availability."""
    rows = C.decision_time(df.drop("decision_as_of"), calendar)
    return add(
        rows,
        {version_field: f"'{version}'", **{k: f"'{v}'" for k, v in common.items()}, "available_at": "CAST(NULL AS TIMESTAMP_NTZ)"},
    )


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free content hash of a table with its row count.

    A cell is its length and text, and a null a sign of its own, so neither the
    borders of cells nor nulls can be mistaken. Rows hash one by one; the hashes are added up in chunks, so duplicates count
    and the reduction is a map-side-combined sum rather than a sorted list.
    """
    names = list(columns or df.columns)
    text = "concat(" + ", ".join(f"coalesce(concat(length(string(`{c}`)), ':', string(`{c}`)), '~')" for c in names) + ")"
    rows = df.selectExpr(f"sha2({text}, 256) AS h")
    chunks = [f"sum(CAST(conv(substring(h, {1 + 15 * i}, 15), 16, 10) AS DECIMAL(38, 0))) AS c{i}" for i in range(4)]
    sums = rows.agg(F.expr("count(1) AS rows"), *[F.expr(c) for c in chunks])
    joined = "concat_ws(':', string(rows), " + ", ".join(f"string(c{i})" for i in range(4)) + ")"
    return sums.selectExpr("rows", f"concat('sha256:', sha2({joined}, 256)) AS content_hash")


def strict_json(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows as JSON text with keys in name order and no NaN (inputs are cleaned at the scan)."""
    listed = ", ".join(f"`{c}`" for c in sorted(columns))
    return df.selectExpr("*", f"to_json(struct({listed}), map('ignoreNullFields', 'false')) AS document")
