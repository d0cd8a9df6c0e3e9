"""Hard negatives by a vertical scan.

A block of rows is stored by dimension: one column of integers each, with its smallest and its largest value. An
anchor reads the columns in the descending order of its own magnitudes. After a few of them, a row's score lies
between its partial sum plus the least and plus the most that the columns still to come can add; rows that these
bounds shut out leave the bitmap of candidates, and further columns are read for the others only. What is left at the
end has its exact score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.vectors import QUERIES, SHARD, best, finite, in_blocks, matrix, meet, written

STEP = 8
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this many hundredths of the positive's.
SHARE = 80


def by_dimension(rows: pa.Table) -> pa.Table:
    """The rows sorted by label, with one column per dimension instead of the vectors."""
    rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("label", "ascending")]))
    values = matrix(rows.column("vector"))
    most = np.abs(values).max(axis=0, initial=0).astype(float)
    if (most**2).sum() >= 2.0**62:
        raise ArithmeticError("scores of such large components do not fit into 64 bits")
    columns = {f"d{i}": values[:, i] for i in range(values.shape[1])}
    return pa.table({"id": rows.column("id"), "label": rows.column("label")} | columns)


class Columns:
    """A block of rows by dimension."""

    def __init__(self, table: pa.Table):
        self.ids = np.asarray(table.column("id"))
        self.labels = np.asarray(table.column("label"))
        self.values = [np.asarray(table.column(i)) for i in range(2, table.num_columns)]
        self.low = np.array([v.min() for v in self.values])
        self.high = np.array([v.max() for v in self.values])

    def scan(self, anchor: np.ndarray, rows: np.ndarray, useful, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``useful`` never shuts out, and their exact scores.

        ``useful(low, high)`` gets the bounds of the scores of the rows that are left and says which of them stay.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor * self.low, anchor * self.high
        least = np.append(np.cumsum(np.minimum(*ends)[order][::-1])[::-1], 0)
        most = np.append(np.cumsum(np.maximum(*ends)[order][::-1])[::-1], 0)
        partial = np.zeros(len(rows), np.int64)
        for begin in range(0, len(order), step):
            for d in order[begin : begin + step]:
                if anchor[d]:
                    partial += anchor[d] * self.values[d][rows]
            after = min(begin + step, len(order))
            stay = useful(partial + least[after], partial + most[after])
            if not stay.all():
                rows, partial = rows[stay], partial[stay]
            if not len(rows):
                break
        return rows, partial


def largest(values: np.ndarray, number: int) -> int | None:
    """The number-th largest value, if there are so many."""
    return None if len(values) < number else np.partition(values, len(values) - number)[len(values) - number]


def for_best(number: int):
    """Rows that may be among the ``number`` best: their upper bound reaches the number-th best lower bound."""

    def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        limit = largest(low, number)
        return np.ones(len(low), bool) if limit is None else high >= limit

    return useful


def for_windows(windows: list[tuple[int, int]], number: int):
    """Rows that may be among the ``number`` best inside one of the windows (least and largest score)."""

    def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for begin, end in windows:
            may = (high >= begin) & (low <= end)
            limit = largest(low[(low >= begin) & (high <= end)], number)
            stay |= may if limit is None else may & (high >= limit)
        return stay

    return useful


def window(score: int, share: int) -> tuple[int, int]:
    """Scores n with share * score <= 100 * n <= 100 * score."""
    return -((-share * score) // 100), score


def hard_negatives(
    rows: DataFrame,
    anchors: DataFrame,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    share: int = SHARE,
    scale: int = 256,
    shard: int = SHARD,
    block: int = QUERIES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row of ``anchors``.

    Components count as floor(scale * x); a score is the integer inner product with the anchor. An anchor's positives
    are its ``positives`` best other rows of its label, its negatives those ``negatives`` best rows of other labels
    whose score is at most the positive's and at least ``share`` hundredths of it; higher scores come first, ties by
    the smaller id. A negative positive score leaves no negatives.

    Rows without an id or label take no part, nor do vectors that are null, empty or hold a null or non-finite
    component; vectors meet only vectors of their own length. Rows that repeat an id are candidates each, but never
    for an anchor of that id as positives; anchors equal in id, label and vector are one anchor, and others that share
    an id are worked on each for itself. Components so large that scores leave 64 bits raise an error.
    """
    usable = f"{id} IS NOT NULL AND {label} IS NOT NULL AND {finite(vector)}"
    whole = f"transform(cast({vector} AS array<double>), x -> bigint(floor({scale}D * x))) AS vector"
    kept = [f"bigint({id}) AS id", f"bigint({label}) AS label", whole]
    shards = in_blocks(rows.where(usable).selectExpr(*kept), shard, "columns", build=by_dimension)
    asked = anchors.where(usable).selectExpr(*kept).distinct().selectExpr("*", "xxhash64(id, label, vector) AS key")

    def positive_rows(table: pa.Table, asked: pa.Table) -> pa.Table:
        columns, found = Columns(table), []
        for key, own, kind, anchor in zip(*(np.asarray(asked.column(c)) for c in ("key", "id", "label")), matrix(asked.column("vector"))):
            begin, end = np.searchsorted(columns.labels, [kind, kind + 1])
            rows = begin + np.flatnonzero(columns.ids[begin:end] != own)
            rows, scores = columns.scan(anchor, rows, for_best(positives))
            by = np.lexsort((columns.ids[rows], -scores))[:positives]
            found += [(key, own, i, s) for i, s in zip(columns.ids[rows[by]], scores[by])]
        return pa.table([pa.array(list(c), pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 4, ["key", "anchor_id", "positive_id", "positive_score"])

    schema = "key bigint, anchor_id bigint, positive_id bigint, positive_score bigint"
    near = meet(shards, in_blocks(asked, block, "anchors"), positive_rows, schema)
    near = written(best(near, ["anchor_id", "key"], "positive_score DESC, positive_id", positives).drop("rank"), "positives")
    scores = near.groupBy("anchor_id", "key").agg(F.collect_set("positive_score").alias("scores"))
    asked = asked.join(scores.withColumnRenamed("anchor_id", "id"), ["id", "key"])

    def negative_rows(table: pa.Table, asked: pa.Table) -> pa.Table:
        columns, found = Columns(table), []
        lists = asked.column("scores").to_pylist()
        for key, own, kind, scores, anchor in zip(*(np.asarray(asked.column(c)) for c in ("key", "id", "label")), lists, matrix(asked.column("vector"))):
            windows = {s: window(s, share) for s in scores if s >= 0}
            rows = np.flatnonzero(columns.labels != kind)
            rows, values = columns.scan(anchor, rows, for_windows(list(windows.values()), negatives))
            for s, (begin, end) in windows.items():
                inside = np.flatnonzero((values >= begin) & (values <= end))
                by = inside[np.lexsort((columns.ids[rows[inside]], -values[inside]))[:negatives]]
                found += [(key, own, s, i, v) for i, v in zip(columns.ids[rows[by]], values[by])]
        names = ["key", "anchor_id", "positive_score", "negative_id", "negative_score"]
        return pa.table([pa.array(list(c), pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 5, names)

    schema = "key bigint, anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    far = meet(shards, in_blocks(asked, block, "windows"), negative_rows, schema)
    far = best(far, ["anchor_id", "key", "positive_score"], "negative_score DESC, negative_id", negatives)
    return near.join(far, ["anchor_id", "key", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"
    )
