"""Vectors in blocks, and the meeting of blocks of queries with all blocks of a table.

A block is a row that holds some rows as Arrow bytes. Blocks of queries are dealt to groups of about ``TOGETHER``. Every
group meets every block of the table, so a block of the table is copied once for each group and a block of queries once
for each block of the table: what is moved grows with rows of the table x rows of the queries / the size of a block, and
memory is bounded by a few blocks of the table and one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.session import scratch_path

SHARD = 4096
QUERIES = 256
#: Blocks of queries that meet a block of the table at once.
TOGETHER = 16


def finite(vector: str) -> str:
    """SQL: the array is not null or empty, and each component is a finite number (not a number counts as above infinity)."""
    return f"coalesce(size({vector}) > 0 AND forall({vector}, x -> abs(x) < double('Infinity')), false)"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, read back from a table in the shared folder."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def in_blocks(rows: DataFrame, size: int, name: str, vector: str = "vector", build: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """(block, dims, data) of all rows, in blocks of at most ``size`` rows whose vectors have one length; written.

    Rows stay in the task that reads them. ``build`` arranges the rows of a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held: dict[int, list[pa.Table]] = {}
        count: dict[int, int] = {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal at
            table = pa.concat_tables(held.pop(dims)).combine_chunks()
            count.pop(dims)
            at += 1
            return pa.RecordBatch.from_pydict({"block": [at], "dims": [dims], "data": [to_bytes(build(table) if build else table)]})

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            lengths = np.asarray(pa.compute.list_value_length(rows.column(vector)))
            for dims in np.unique(lengths).tolist():
                part = rows.filter(pa.array(lengths == dims))
                while part.num_rows:
                    taken = part.slice(0, size - count.get(dims, 0))
                    held.setdefault(dims, []).append(taken)
                    count[dims] = count.get(dims, 0) + taken.num_rows
                    part = part.slice(taken.num_rows)
                    if count[dims] == size:
                        yield block(dims)
        for dims in list(held):
            yield block(dims)

    return written(rows.mapInArrow(run, "block bigint, dims bigint, data binary"), name)


def meet(shards: DataFrame, queries: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The rows of ``search(shard, queries)`` for every group of blocks of queries and every block of the table."""
    number, groups = max(shards.count(), 1), max(-(-queries.count() // TOGETHER), 1)
    spot, group = f"pmod(xxhash64(block), {number}L) AS spot", f"pmod(xxhash64(block), {groups}L) AS part"
    left = shards.selectExpr("dims", "data", spot, f"explode(sequence(0L, {groups - 1}L)) AS part")
    right = queries.selectExpr("dims", "data", group, f"explode(sequence(0L, {number - 1}L)) AS spot")

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asked.num_rows:
            return pa.table({})
        together = pa.concat_tables([from_bytes(data) for data in asked.column("data")])
        return pa.concat_tables([search(from_bytes(data), together) for data in blocks.column("data")])

    keys = ["spot", "part", "dims"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def best(rows: DataFrame, keys: list[str], order: str, number: int) -> DataFrame:
    """The first ``number`` rows of each key and their ``rank`` (from 1); Spark keeps no more of each task's rows."""
    names = ", ".join(keys)
    ranked = rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {names} ORDER BY {order})"))
    return ranked.where(f"rank <= {number}")
