"""Packing of tokenised documents into windows by minimum bin slack.

Every document is cut into whole windows and a rest. Only the histogram of the lengths (at most ``window`` rows,
whatever the corpus) reaches the driver. There each window starts from the longest length left and takes the multiset
of remaining lengths that comes closest to the window: a subset-sum over a bitset, with bounded multiplicities,
backtracked to counts. A multiset is used as often as the histogram allows, so the plan stays small, too.

A piece finds its place through its rank among all pieces of its length: the rank in its task (written with the
piece) plus the pieces of that length in earlier tasks. No key meets in one task, however many equal lengths there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm.tokens import encoder
from volpanel.llm.words import blocks
from volpanel.session import scratch_path

WINDOW = 2048
END = 1
BLOCK_BYTES = 1 << 20


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (each at most ``counts`` times) whose sum is the largest that fits into ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    value = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> value & 1:
            value -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """Multisets of lengths and how often each is used; together they take every piece once."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        chosen = closest(left, window - seed)
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[k] // m for k, m in chosen.items())
        for k, m in chosen.items():
            left[k] -= times * m
            if not left[k]:
                del left[k]
        out.append((times, chosen))
    return out


def places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of that length in a window, their first offset), sorted."""
    rows, used, sequence = [], {}, 0
    for times, chosen in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            many = chosen[length]
            rows.append((length, used.get(length, 0), sequence, many, offset))
            used[length] = used.get(length, 0) + times * many
            offset += length * many
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pieces_of(docs: DataFrame, tokenizer: str, id: str, text: str, window: int, end: int, with_ids: bool) -> DataFrame:
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        task = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                ids, at = encode([t or "" for t in block.column("text").to_pylist()])
                sizes = np.diff(at) + 1
                owner = np.repeat(np.arange(len(sizes)), -(-sizes // window))
                number = np.arange(len(owner)) - np.repeat(np.cumsum(-(-sizes // window)) - -(-sizes // window), -(-sizes // window))
                start = number * window
                length = np.minimum(sizes[owner] - start, window)
                crc = np.empty(len(owner), np.int64)
                cut = []
                for k, (d, s, n) in enumerate(zip(owner.tolist(), start.tolist(), length.tolist())):
                    own = ids[at[d] + s : min(at[d] + s + n, at[d + 1])].astype("<u4")
                    if s + n == sizes[d]:
                        own = np.append(own, np.uint32(end)).astype("<u4")
                    crc[k] = zlib.crc32(own.tobytes())
                    if with_ids:
                        cut.append(own.astype(np.int32))
                # rank among the pieces of this length in this task
                order = np.argsort(length, kind="stable")
                values, first, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(first, many)
                rank += seen[length]
                seen[values] += many
                columns = {
                    "doc_id": block.column("doc_id").take(pa.array(owner)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crc),
                    "doc_tokens": pa.array(sizes[owner]),
                    "task": pa.array(np.full(len(owner), task, np.int32)),
                    "task_rank": pa.array(rank),
                }
                if with_ids:
                    columns["ids"] = pa.array(cut, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return source.mapInArrow(
        run,
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, task_rank bigint"
        + ", ids array<int>" * with_ids,
    )


def pack(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on request).

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read. A null or empty text is the end
    id alone; repeated rows are packed one by one; an empty table gives no rows. Sequence ids are 0, 1, ... without
    gaps, offsets in a sequence begin at 0 without gaps, and no sequence is longer than ``window``.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    pieces_of(docs, tokenizer, id, text, window, end, with_ids).write.parquet(path)
    pieces = spark.read.parquet(path)
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(plan_windows(histogram, window)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        keys = (place[:, 0] << 44) | place[:, 1]
        for batch in batches:
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
            length, rank = get("length"), get("task_rank") + get("before")
            row = place[np.searchsorted(keys, (length << 44) | rank, side="right") - 1] if len(length) else place[:0]
            nth = rank - row[:, 1]
            columns = {f.name: batch.column(f.name) for f in batch.schema if f.name not in ("task", "task_rank", "before")}
            columns["sequence_id"] = pa.array(row[:, 2] + nth // row[:, 3])
            columns["offset"] = pa.array(row[:, 4] + nth % row[:, 3] * length)
            yield pa.RecordBatch.from_pydict(columns)

    joined = pieces.join(before, ["task", "length"]).select(*pieces.columns, "before")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("task", "task_rank"))
    return joined.mapInArrow(run, f"{kept}, sequence_id bigint, offset bigint").withColumnRenamed("doc_id", id)
