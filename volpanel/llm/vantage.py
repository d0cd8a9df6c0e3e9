"""Nearest neighbours by vantage-point trees, one per block of rows.

A node of a tree keeps a vantage point and, for either half of its rows, the least and the largest distance to that
point. By the triangle inequality no row of a half is nearer to the query than the gap between the query's own
distance and that range. A half is left out if its gap exceeds ``factor`` times the distance of the worst neighbour
held so far: with a factor of 1 the search is exact, smaller ones leave out more halves and lose some neighbours.
Each query first goes down to the leaf of its nearer halves, which gives it neighbours to begin with. Then the block of
queries goes through the tree together, once: a leaf is compared with all queries that are still open for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.vectors import QUERIES, SHARD, best, finite, in_blocks, matrix, meet

LEAF = 64
#: Of a node: its rows (from, to), the row of its vantage point, its children, and the ranges of both.
NODE = ("begin", "end", "point", "left", "right", "left_low", "left_high", "right_low", "right_high")
SLACK = 1e-9
LAST = np.iinfo(np.int64).max


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of equal-shaped rows, summed from the first component to the last."""
    return np.sqrt(np.cumsum((a - b) ** 2, axis=-1)[..., -1])


def build_tree(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and the nodes (columns of ``NODE``); the first one is the root.

    The vantage point is the row farthest from the first one of the node, and halves are cut by position, so equal
    distances (copies) never make a half empty.
    """
    order = np.arange(len(vectors))
    nodes: list[list[float]] = [[0, len(vectors), -1, -1, -1, 0, 0, 0, 0]]
    todo = [0]
    while todo:
        at = todo.pop()
        begin, end = int(nodes[at][0]), int(nodes[at][1])
        if end - begin <= leaf:
            continue
        own = order[begin:end]
        far = own[np.argmax(((vectors[own] - vectors[own[0]]) ** 2).sum(axis=1))]
        d = distances(vectors[own], vectors[far])
        by = np.argsort(d, kind="stable")
        order[begin:end], d = own[by], d[by]
        half = (end - begin) // 2
        nodes[at][2:] = [far, len(nodes), len(nodes) + 1, d[0], d[half - 1], d[half], d[-1]]
        todo += [len(nodes), len(nodes) + 1]
        nodes.append([begin, begin + half, -1, -1, -1, 0, 0, 0, 0])
        nodes.append([begin + half, end, -1, -1, -1, 0, 0, 0, 0])
    table = np.array(nodes, float)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    inner = table[:, 2] >= 0
    table[inner, 2] = place[table[inner, 2].astype(int)]
    return order, table


def with_tree(rows: pa.Table) -> pa.Table:
    """The rows in the order of their tree; the nodes are one more list, in the first row."""
    order, nodes = build_tree(matrix(rows.column("vector")))
    rows = rows.take(pa.array(order))
    lists = [nodes.reshape(-1)] + [None] * (rows.num_rows - 1)
    return rows.append_column("tree", pa.array(lists, pa.list_(pa.float64())))


class Search:
    """The ``number`` nearest rows of one tree for a block of queries."""

    def __init__(self, vectors, ids, nodes, queries, own, number, factor):
        self.vectors, self.ids, self.nodes, self.queries, self.own = vectors, ids, nodes, queries, own
        self.number, self.factor, self.compared = number, factor, 0
        self.squares, self.lengths = (vectors**2).sum(axis=1), (queries**2).sum(axis=1)
        self.home = np.full(len(queries), -1)
        self.found = np.full((len(queries), number), np.inf)
        self.who = np.full((len(queries), number), LAST)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        everyone = np.arange(len(self.queries))
        self.enter(0, everyone)
        self.visit(0, everyone)
        return self.found, self.who

    def gaps(self, at: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the queries are off the ranges of the left and of the right child; not positive inside."""
        point, (low, high, low2, high2) = int(self.nodes[at, 2]), self.nodes[at, 5:]
        off = self.queries[active] - self.vectors[point]
        d = np.sqrt(np.einsum("ij,ij->i", off, off))
        return np.maximum(low - d, d - high), np.maximum(low2 - d, d - high2)

    def open(self, gap: np.ndarray, active: np.ndarray) -> np.ndarray:
        worst = self.found[active, -1]
        return gap <= self.factor * worst + SLACK * (1 + np.where(np.isinf(worst), 0, worst))

    def enter(self, at: int, active: np.ndarray) -> None:
        """Down to one leaf, the ``home`` of a query."""
        if not len(active):
            return
        begin, end, point, left, right = self.nodes[at, :5].astype(int)
        if point < 0:
            self.home[active] = at
            return self.scan(begin, end, active)
        gap, gap2 = self.gaps(at, active)
        first = np.maximum(gap, 0) <= np.maximum(gap2, 0)
        self.enter(left, active[first])
        self.enter(right, active[~first])

    def visit(self, at: int, active: np.ndarray) -> None:
        """All leaves but the home that are open when their turn comes."""
        if not len(active):
            return
        begin, end, point, left, right = self.nodes[at, :5].astype(int)
        if point < 0:
            return self.scan(begin, end, active[self.home[active] != at])
        gap, gap2 = self.gaps(at, active)
        self.visit(left, active[self.open(gap, active)])
        self.visit(right, active[self.open(gap2, active)])

    def scan(self, begin: int, end: int, active: np.ndarray) -> None:
        rows, ids = self.vectors[begin:end], self.ids[begin:end]
        self.compared += len(active) * len(rows)
        worst = self.found[active, -1]
        # squares without those of the queries; they only tell who cannot come in, the rest is taken exactly
        rough = self.squares[begin:end] * (1 - SLACK) - 2 * (self.queries[active] @ rows.T)
        near = rough <= (worst**2 - self.lengths[active] + SLACK * (1 + self.lengths[active]))[:, None]
        q, r = np.nonzero(near)
        other = ids[r] != self.own[active[q]]
        near[q[~other], r[~other]] = False
        q, r = q[other], r[other]
        if not len(q):
            return
        d = np.full(near.shape, np.inf)
        d[q, r] = distances(self.queries[active[q]], rows[r])
        some = np.unique(q)
        d = np.concatenate([self.found[active[some]], d[some]], axis=1)
        who = np.concatenate([self.who[active[some]], np.where(near[some], ids, LAST)], axis=1)
        by = np.lexsort((who, d), axis=1)[:, : self.number]
        self.found[active[some]] = np.take_along_axis(d, by, axis=1)
        self.who[active[some]] = np.take_along_axis(who, by, axis=1)


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    number: int = 10,
    factor: float = 1.0,
    shard: int = SHARD,
    block: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``number`` rows nearest to each row of ``queries``, nearest first.

    Score is the Euclidean distance in double precision; ties go to the smaller id. Rows with the query's own id are
    no candidates. Rows without an id take no part, nor do vectors that are null, empty, zero or hold a null or
    non-finite component; vectors meet only vectors of their own length. Rows that repeat an id are candidates each;
    queries equal in id and vector are one query, queries equal in the id alone are searched each for itself. Empty
    tables give no rows.
    """
    usable = f"{id} IS NOT NULL AND {finite(vector)} AND exists({vector}, x -> x <> 0)"
    kept = [f"bigint({id}) AS id", f"cast({vector} AS array<double>) AS vector"]
    shards = in_blocks(rows.where(usable).selectExpr(*kept), shard, "trees", build=with_tree)
    asked = queries.where(usable).selectExpr(*kept).distinct().selectExpr("*", "xxhash64(id, vector) AS key")
    blocks = in_blocks(asked, block, "queries")

    def search(table: pa.Table, asked: pa.Table) -> pa.Table:
        nodes = np.asarray(table.column("tree")[0].values).reshape(-1, len(NODE))
        ids, own, key = (np.asarray(c) for c in (table.column("id"), asked.column("id"), asked.column("key")))
        found, who = Search(matrix(table.column("vector")), ids, nodes, matrix(asked.column("vector")), own, number, factor).run()
        q, r = np.nonzero(np.isfinite(found))
        return pa.table({"key": key[q], "query_id": own[q], "vec_id": who[q, r], "score": found[q, r]})

    found = meet(shards, blocks, search, "key bigint, query_id bigint, vec_id bigint, score double")
    return best(found, ["query_id", "key"], "score, vec_id", number).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
