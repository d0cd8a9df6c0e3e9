"""Blocks of queries go through a tree, and meet a block of rows, together."""

from collections import Counter

import numpy as np
import pyarrow as pa

from volpanel.llm.vantage import LEAF, Search, build_tree
from volpanel.llm.vectors import TOGETHER, in_blocks, meet


def test_a_leaf_is_compared_with_all_open_queries_at_once():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(2048, 32))
    rows[1500:1600] = rows[7]
    order, nodes = build_tree(rows)
    leaves = int((nodes[:, 2] < 0).sum())
    scans, ids = [], np.arange(2048)

    class Counted(Search):
        def scan(self, begin, end, active):
            scans.append((begin, end))
            super().scan(begin, end, active)

    for factor in (1.0, 0.5):
        scans.clear()
        found, who = Counted(rows[order], ids[order], nodes, rows[:200], ids[:200], 10, factor).run()
        assert leaves >= 2048 / LEAF and len(scans) <= 2 * leaves  # as a home, and for the other queries
        if factor == 1.0:
            for i in range(200):
                d = np.sqrt(np.cumsum((rows[i] - rows) ** 2, axis=1)[:, -1])
                by = np.lexsort((ids, np.where(ids == i, np.inf, d)))[:10]
                assert who[i].tolist() == by.tolist() and np.array_equal(found[i], d[by])


def test_blocks_of_queries_meet_a_block_of_rows_together(spark):
    rows = spark.range(0, 90, numPartitions=3).selectExpr("id", "array(double(id), 1D) AS vector")
    rows = rows.union(spark.range(90, 95, numPartitions=1).selectExpr("id", "array(double(id)) AS vector"))
    asked = spark.range(0, 200, numPartitions=2).selectExpr("id", "array(double(id), 2D) AS vector")
    shards, blocks = in_blocks(rows, 10, "rows"), in_blocks(asked, 5, "asked")
    assert blocks.count() == 40 and blocks.count() > 2 * TOGETHER

    def search(table: pa.Table, asked: pa.Table) -> pa.Table:
        pairs = [(i, j) for i in table.column("id").to_pylist() for j in asked.column("id").to_pylist()]
        call = f"{table.column('id')[0]} {asked.column('id')[0]}"
        return pa.table({"call": [call] * len(pairs), "row": [i for i, _ in pairs], "query": [j for _, j in pairs]})

    found = meet(shards, blocks, search, "call string, row bigint, query bigint").collect()
    assert Counter((r["row"], r["query"]) for r in found) == Counter({(i, j): 1 for i in range(90) for j in range(200)})
    assert len({r["call"] for r in found}) <= 9 * -(-40 // TOGETHER)
    assert meet(shards.limit(0), blocks, search, "call string, row bigint, query bigint").count() == 0
    assert meet(shards, blocks.limit(0), search, "call string, row bigint, query bigint").count() == 0
