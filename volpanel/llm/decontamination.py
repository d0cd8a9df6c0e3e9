"""Benchmark decontamination through a positional inverted index.

Training texts become blocks of about 1 MB. A block is one row of the index: the documents in it and, for each term,
the sorted positions where it stands (``terms``, ``counts``, ``positions``). Positions run through the whole block,
with a gap of 64 between documents, so no match reaches over a document's end. The index is cut by documents, not by
terms: a very frequent word is spread over all blocks and no shuffle is needed at all.

A search takes the windows of the test items. In each block every window starts from the postings of its rarest
present term, moved by that term's offset, and is intersected with the lists of its other terms from rare to
frequent. A proximity match lets ``misses`` terms be absent and the others stand up to ``slack`` words from their
place; it starts from the ``misses + 1`` rarest terms, one of which must be there.

Test windows travel to the tasks in sets of at most ``test_words`` words (a proven bound); a larger test set is
searched set by set over the stored index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.words import blocks, ragged, words_of
from volpanel.session import scratch_path

GAP = 64
WINDOW = 13
TEST_WORDS = 1_000_000
CANDIDATES = 1 << 20


@dataclass
class Windows:
    """Windows of test items: rows of indices into ``terms`` (-1 beyond a short window), and each one's item."""

    terms: np.ndarray
    slots: np.ndarray
    lengths: np.ndarray
    item: np.ndarray
    items: list[str]


def windows_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> Windows:
    """All windows of ``window`` consecutive words; a shorter item with words is one window. Equal ids are one item."""
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    _, _, _, hashes, first = words_of(pa.array([t for _, t in items], pa.string()))
    terms, slot_of = np.unique(hashes, return_inverse=True)
    slots, lengths, owner = [], [], []
    for k, (name, _) in enumerate(items):
        own = slot_of[first[k] : first[k + 1]]
        if not len(own):
            continue
        size = min(window, len(own))
        for i in range(len(own) - size + 1):
            row = np.full(window, -1, np.int64)
            row[:size] = own[i : i + size]
            slots.append(row)
            lengths.append(size)
            owner.append(number[name])
    if not slots:
        return Windows(terms, np.zeros((0, window), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), names)
    table = np.column_stack([np.array(owner), np.array(lengths), np.array(slots)])
    table = np.unique(table, axis=0)
    return Windows(terms, table[:, 2:], table[:, 1], table[:, 0], names)


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: np.ndarray | None = None) -> DataFrame:
    """Postings of every block. ``vocabulary`` (sorted term hashes) limits the terms; without it all terms are kept."""
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                _, _, _, hashes, first = words_of(block.column("text"))
                counts = np.diff(first)
                gaps = np.arange(len(counts)) * GAP
                at = np.arange(len(hashes)) + np.repeat(gaps, counts)
                if vocabulary is not None:
                    if not len(vocabulary):
                        keep = np.zeros(len(hashes), bool)
                    else:
                        near = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                        keep = vocabulary[near] == hashes
                    hashes, at = hashes[keep], at[keep]
                order = np.argsort(hashes, kind="stable")
                terms, sizes = np.unique(hashes, return_counts=True)
                row = {
                    "block": pa.array([uuid.uuid4().hex]),
                    "ids": pa.ListArray.from_arrays([0, block.num_rows], block.column("id")),
                    "firsts": pa.array([(first[:-1] + gaps).astype(np.int64)]),
                    "words": pa.array([counts.astype(np.int64)]),
                    "terms": pa.array([terms.view(np.int64)]),
                    "counts": pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
                    "positions": pa.array([at[order].astype(np.int32)], pa.list_(pa.int32())),
                }
                yield pa.RecordBatch.from_pydict(row)

    return source.mapInArrow(
        run,
        f"block string, ids array<{kind}>, firsts array<bigint>, words array<bigint>, "
        "terms array<bigint>, counts array<int>, positions array<int>",
    )


def match_block(terms, counts, positions, w: Windows, misses: int = 0, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Window and start position of every match in one block."""
    n, width = w.slots.shape
    if not n or not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, w.terms), len(terms) - 1)
    there = terms[at] == w.terms
    ends = np.cumsum(counts, dtype=np.int64)
    lists = np.repeat(np.arange(len(terms), dtype=np.int64), counts)
    keys = (lists << 32) | (positions.astype(np.int64) + GAP)
    big = np.int64(1) << 40
    size = np.where(there, counts[at], 0).astype(np.int64)
    cost = np.where(w.slots < 0, big, size[w.slots])
    order = np.argsort(cost, axis=1, kind="stable")
    found = (cost == 0).sum(axis=1)
    allowed = np.where(w.lengths > 2 * misses + 3, misses, 0)
    alive = np.flatnonzero(found <= allowed)
    out_w, out_s = [], []
    for seed in range(misses + 1):
        # the seed-th rarest term that is present
        pick = found[alive] + seed if misses else np.zeros(len(alive), np.int64)
        use = alive[(seed <= allowed[alive] - found[alive]) & (pick < w.lengths[alive])]
        rank = found[use] + seed if misses else np.zeros(len(use), np.int64)
        offset = order[use, rank]
        slot = w.slots[use, offset]
        weight = size[slot]
        cut = np.searchsorted(np.cumsum(weight), np.arange(CANDIDATES, weight.sum() + CANDIDATES, CANDIDATES))
        begin = 0
        for end in [*dict.fromkeys((cut + 1).tolist())]:
            part = slice(begin, min(end, len(use)))
            begin = part.stop
            if part.start >= part.stop:
                continue
            own = np.repeat(np.arange(part.start, part.stop), weight[part])
            term = at[slot[part]]
            start = positions[ragged(ends[term] - counts[term], weight[part])].astype(np.int64) - offset[own]
            missed = np.zeros(len(own), np.int64)
            for k in range(width):
                row = use[own]
                place = order[row, k]
                real = k < w.lengths[row]
                s = w.slots[row, place]
                want = (at[s].astype(np.int64) << 32) | np.maximum(start + place + GAP - slack, 0)
                spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                ok = there[s] & (keys[spot] >= want) & (keys[spot] <= want + 2 * slack)
                missed += real & ~ok
                keep = missed <= allowed[row]
                own, start, missed = own[keep], start[keep], missed[keep]
                if not len(own):
                    break
            out_w.append(use[own])
            out_s.append(start)
    if not out_w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_w), np.concatenate(out_s)


def search(index: DataFrame, test: Windows, misses: int = 2, slack: int = 3) -> DataFrame:
    """Per document with its hits: merged hit intervals, items matched exactly, and items matched in proximity only."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    parts = (test.terms, test.slots, test.lengths, test.item, test.items)
    shared = index.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(*shared.value)
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, r=r: batch.column(name)[r].values.to_numpy(zero_copy_only=False)
                ids, firsts, words = batch.column("ids")[r].values, get("firsts"), get("words")
                n = len(ids)
                terms, counts, positions = get("terms").view(np.uint64), get("counts"), get("positions")
                row, start = match_block(terms, counts, positions, w)
                near_row, near_start = match_block(terms, counts, positions, w, misses, slack)
                total = int(firsts[-1] + words[-1] + GAP) if n else 0
                edge = np.zeros(total + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + w.lengths[row], -1)
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
                n_hit = hit[firsts + words] - hit[firsts] if n else np.zeros(0, np.int64)
                covered = np.diff(np.concatenate([[0], (np.diff(hit) > 0).astype(np.int8), [0]]))
                begins, stops = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
                of = lambda s: np.searchsorted(firsts, s, side="right") - 1
                exact = np.unique(np.column_stack([of(start), w.item[row]]), axis=0)
                near = np.unique(np.column_stack([of(np.maximum(near_start, 0)), w.item[near_row]]), axis=0)
                names = pa.array(w.items, pa.string())

                def lists(owner, values):
                    at = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(at), values)

                home = of(begins)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([batch.column("block")[r].as_py()] * n, pa.string()),
                        "place": pa.array(np.arange(n, dtype=np.int32)),
                        "id": ids,
                        "n_words": pa.array(words),
                        "n_hit": pa.array(n_hit.astype(np.int64)),
                        "begins": lists(home, pa.array((begins - firsts[home]).astype(np.int64))),
                        "ends": lists(home, pa.array((stops - firsts[home]).astype(np.int64))),
                        "items": lists(exact[:, 0], names.take(pa.array(exact[:, 1]))),
                        "near_items": lists(near[:, 0], names.take(pa.array(near[:, 1]))),
                    }
                )

    return index.mapInArrow(
        run,
        f"block string, place int, id {kind}, n_words bigint, n_hit bigint, begins array<bigint>, ends array<bigint>, "
        "items array<string>, near_items array<string>",
    )


def decontaminate(
    docs: DataFrame,
    tests: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    misses: int = 2,
    slack: int = 3,
    test_words: int = TEST_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit (words inside a matched window), items, near_items, contaminated.

    ``contaminated``: n_hit > 0 and at least a twentieth of the words are hit. Null and empty texts have no words and
    are never contaminated; items without words have no windows; rows with equal ids are judged one by one; test rows
    with equal ids are one item. The index is written to the shared folder and searched from there.
    """
    spark = docs.sparkSession
    given = tests.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    given = given.where("item IS NOT NULL AND text IS NOT NULL")
    total = given.selectExpr("coalesce(sum(size(split(lower(text), '[^0-9a-z\\\\x{80}-\\\\x{10FFFF}]+'))), 0)").head()[0]
    sets = max(1, -(-int(total) // test_words))
    parts = [
        windows_of([(r.item, r.text) for r in given.where(F.expr(f"pmod(xxhash64(item), {sets}) = {k}")).collect()], window)
        for k in range(sets)
    ]
    vocabulary = np.unique(np.concatenate([p.terms for p in parts]))
    path = scratch_path(spark, "postings")
    build_index(docs, id, text, vocabulary if len(vocabulary) <= test_words else None).write.parquet(path)
    index = spark.read.parquet(path)
    found = [search(index, p, misses, slack) for p in parts]
    if sets == 1:
        rows = found[0].drop("block", "place", "begins", "ends")
    else:
        rows = found[0]
        for part in found[1:]:
            rows = rows.unionByName(part)
        rows = rows.groupBy("block", "place").agg(
            F.first("id").alias("id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list(F.arrays_zip("begins", "ends"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"),
        )
        rows = rows.withColumn(
            "n_hit",
            F.expr(
                "aggregate(array_sort(spans), named_struct('n', 0L, 'to', 0L), (a, s) -> named_struct("
                "'n', a.n + greatest(0L, s.ends - greatest(s.begins, a.to)), 'to', greatest(a.to, s.ends)), a -> a.n)"
            ),
        ).drop("block", "place", "spans")
    return rows.select(
        F.col("id").alias(id),
        "n_words",
        "n_hit",
        F.array_sort("items").alias("items"),
        F.array_sort(F.array_except("near_items", "items")).alias("near_items"),
        F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"),
    )
