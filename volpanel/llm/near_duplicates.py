"""Near-duplicate classes by order MinHash.

Texts become words, words become k-mers (five words), and equal k-mers of a text are told apart by their occurrence
number. One sketch takes the ``keep`` smallest labelled k-mers under a random hash and lists them in the order of the
text, so two texts share it only if they share these k-mers in the same order: it follows edit similarity. A second
sketch takes the smallest k-mers of the set, without occurrence numbers and in no order: it follows the Jaccard
similarity, whatever is moved or repeated. Sketches of a kind are joined to bands; texts that share a band are
candidates, and a banded alignment of their k-mers or the Jaccard similarity decides.

Texts with the same words are one node from the start. In a band every node is compared with its hub, the node that
meets most others in all its bands, instead of with all others: of a text and its edited copies, that is the text. Only
bands whose nodes are not of one component by then go on. Where a node meets few nodes of other components in a band,
they are compared unless their distances to the hub rule a link out (Jaccard distances are metrics). Elsewhere nodes are
compared with some nodes drawn from all but the largest component of the band, as long as one in ten comparisons finds
a link. What such bands then still hold apart goes to an exact join: two linked texts share one of the first k-mers of
either in any order that is the same for all (prefix filter), so each node is listed under its rarest ones, and nodes of
different components that meet there are compared unless sizes and places rule a link out. No pair of a band is left
out; approximate is only which texts share a band.

Rounds lower each node's label to the smallest one within two links, which is enough to stop comparing what is known
to be linked; the components of all links found are taken once, at the end.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.graph import components
from volpanel.llm.words import blocks, mix, words_of
from volpanel.session import durable, scratch_path

K = 5
SIMILARITY = 0.8
KEEP = 2
BANDS = 20
ROWS = 3
SMALL = 24
PIVOTS = 3
#: Nodes are drawn again as long as more than this share of the comparisons finds a link.
WORTH = 0.1
#: k-mers are counted in so many slots, in blocks of ``BLOCK``, to put rare ones first; any count gives the same links.
SLOTS = 1 << 22
BLOCK = 1 << 16
PLACE = np.uint64((1 << 28) - 1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def kmers(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers and the first one of each text; a text of fewer words than k, but not none, has one."""
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    begin = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], sizes)
    out = np.zeros(at[-1], np.uint64)
    short = np.repeat(counts < k, sizes)
    stop = np.repeat(first[1:], sizes)
    for j in range(k):
        spot = begin + j
        there = spot < stop
        word = hashes[np.minimum(spot, max(len(hashes) - 1, 0))] if len(hashes) else out
        out = mix((out + STEP) * np.uint64(0xD1342543DE82EF95) + np.where(there | ~short, word, 0).astype(np.uint64))
    return out, at


def occurrences(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often the value stood in its text before."""
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    own = mix(values + owner * STEP)
    order = np.argsort(own, kind="stable")
    new = np.ones(len(own), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    begin = np.flatnonzero(new)
    out = np.empty(len(own), np.uint64)
    out[order] = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    return out


def digests(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits for the word sequence of each text."""
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    one = mix(hashes + place * STEP)
    two = mix(one ^ np.uint64(0xA0761D6478BD642F))
    total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[first])
    table = np.column_stack([total(one), total(two)]).astype(">u8")
    return [row.tobytes() for row in table]


def bands(values: np.ndarray, at: np.ndarray, keep: int = KEEP, rows: int = ROWS, number: int = BANDS, seed: int = 11) -> np.ndarray:
    """Bands of all texts that have k-mers (a row each): ``number`` by order MinHash, then as many by plain MinHash."""
    full = np.flatnonzero(np.diff(at) > 0)
    numbers = occurrences(values, at)
    labelled = mix(values + numbers * np.uint64(0xE7037ED1A0B428DB))
    first = np.flatnonzero(numbers == 0)
    firsts = np.searchsorted(first, at[:-1][full])
    rng = np.random.default_rng(seed)
    place = np.arange(len(values), dtype=np.uint64)
    out = np.zeros((len(full), 2 * number), np.uint64)
    starts = at[:-1][full]

    def smallest(v: np.ndarray, starts: np.ndarray, where: np.ndarray | None = None) -> list[np.ndarray]:
        spots = []
        for _ in range(keep):
            low = np.minimum.reduceat(v, starts)
            spot = (low & PLACE).astype(np.int64)
            spot = np.where(low == np.uint64(2**64 - 1), spots[-1] if spots else spot, spot)
            v[spot if where is None else where[spot]] = np.uint64(2**64 - 1)
            spots.append(spot)
        return spots

    for i in range(rows * number):
        a, b = rng.integers(1, 2**63, 2, dtype=np.uint64)
        v = (labelled ^ a) * (b | np.uint64(1))
        v = (v ^ (v >> np.uint64(31))) * STEP
        v = (v & ~PLACE) | place
        plain = None if len(first) == len(v) else v[first]
        ordered = smallest(v, starts)
        # without repeats both sketches have the same k-mers
        plain = ordered if plain is None else smallest(plain, firsts, np.cumsum(numbers == 0) - 1)
        for column, spots in ((i // rows, np.sort(np.column_stack(ordered), axis=1).T), (number + i // rows, plain)):
            sketch = np.zeros(len(full), np.uint64)
            for spot in spots:
                sketch = mix(sketch * STEP + values[spot])
            out[:, column] = mix(out[:, column] * STEP + sketch + np.uint64(column + 1))
    return out


def sketches(docs: DataFrame, k: int, keep: int, rows: int, number: int) -> DataFrame:
    """(id, node, bands) of every row of (id, text); texts without words have no node."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                _, _, _, hashes, first = words_of(block.column("text"))
                values, at = kmers(hashes, first, k)
                full = np.diff(at) > 0
                nodes = digests(hashes, first)
                table = bands(values, at, keep, rows, number).view(np.int64)
                many = np.where(np.diff(first) > k, 2 * number, 0)  # shorter ones can only have equal words
                table = table[(many > 0)[full]]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(table.reshape(-1))
                )
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": block.column("id"),
                        "node": pa.array([n if f else None for n, f in zip(nodes, full)], pa.binary()),
                        "bands": lists,
                    }
                )

    return docs.mapInArrow(run, f"id {kind}, node binary, bands array<bigint>")


def increasing(values: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(values) < 2 or (np.diff(values) > 0).all():
        return len(values)
    tails: list[int] = []
    for v in values.tolist():
        i = bisect_left(tails, v)
        tails[i : i + 1] = [v]
    return len(tails)


def labelled(values: np.ndarray) -> np.ndarray:
    """The k-mers of one text, told apart by their occurrence number."""
    return mix(values + occurrences(values, np.array([0, len(values)])) * STEP)


def similarity(a: np.ndarray, b: np.ndarray, share: float = SIMILARITY) -> tuple[float, float, float]:
    """Of two k-mer sequences: share of aligned k-mers among all (banded, in order), and the Jaccard similarities of
    the k-mer sets and of the labelled k-mers; the last is never below the first.

    Occurrence-labelled k-mers match at one place at most, so the longest common subsequence inside the band is the
    longest increasing run of match positions. An alignment of the wanted similarity never leaves the band.
    """
    one, two = np.unique(a), np.unique(b)
    if len(one) == len(a) and len(two) == len(b):  # no repeats: labels change nothing
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        jaccard = bound = len(i) / max(len(a) + len(b) - len(i), 1)
    else:
        common = len(np.intersect1d(one, two, assume_unique=True))
        jaccard = common / max(len(one) + len(two) - common, 1)
        _, i, j = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
        bound = len(i) / max(len(a) + len(b) - len(i), 1)
    if jaccard == 0:
        return 0.0, 0.0, 0.0
    if min(len(a), len(b)) < share * max(len(a), len(b)):
        return 0.0, jaccard, bound
    width = int((1 - share) * max(len(a), len(b))) + 1
    inside = np.abs(i - j) <= width
    i, j = i[inside], j[inside]
    aligned = increasing(j[np.argsort(i)])
    return aligned / (len(a) + len(b) - aligned), jaccard, bound


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, read back from a table in the shared folder."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def stored_kmers(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, kmers, is_hub) of the texts of (node, id, is_hub); k-mers as 32 bits each, which halves what is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                _, _, _, hashes, first = words_of(block.column("text"))
                values, at = kmers(hashes, first, k)
                # of rows with equal ids, those with other words are not meant
                own = [d == n for d, n in zip(digests(hashes, first), block.column("node").to_pylist())]
                rows = {
                    "node": block.column("node"),
                    "kmers": pa.array([(values[i:j] >> np.uint64(32)).astype(np.uint32).tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()),
                    "is_hub": block.column("is_hub"),
                }
                yield pa.RecordBatch.from_pydict(rows).filter(pa.array(own, pa.bool_()))

    texts = docs.join(wanted, "id").select("node", "is_hub", "text")
    return written(texts.mapInArrow(run, "node binary, kmers binary, is_hub boolean"), "kmers")


def compare(pairs: DataFrame, stored: DataFrame, share: float, hubs: bool = False) -> DataFrame:
    """(a, b, jaccard, bound, linked) of node pairs and their other columns; ``hubs``: b is always a hub."""
    left = stored.select(F.col("node").alias("a"), F.col("kmers").alias("ka"))
    right = (stored.where("is_hub") if hubs else stored).select(F.col("node").alias("b"), F.col("kmers").alias("kb"))
    # the side where one node meets very many comes first, while the rows are still narrow
    rows = pairs.hint("merge").join(right, "b").join(left.hint("merge"), "a")
    others = [c for c in pairs.columns if c not in ("a", "b")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                similarity(np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64), np.frombuffer(y.as_buffer(), np.uint32).astype(np.uint64), share)
                for x, y in zip(batch.column("ka"), batch.column("kb"))
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "a": batch.column("a"),
                    "b": batch.column("b"),
                    "jaccard": pa.array([f[1] for f in found], pa.float64()),
                    "bound": pa.array([f[2] for f in found], pa.float64()),
                    "linked": pa.array([max(f[:2]) >= share for f in found], pa.bool_()),
                }
                | {c: batch.column(c) for c in others}
            )

    kinds = "".join(f", {c} {pairs.schema[c].dataType.simpleString()}" for c in others)
    return written(rows.mapInArrow(align, "a binary, b binary, jaccard double, bound double, linked boolean" + kinds), "compared")


def lowered(links: DataFrame) -> DataFrame:
    """(root, to) of every root of (ra, rb): the smallest root within two links of it."""
    both = links.selectExpr("ra AS a", "rb AS b").union(links.selectExpr("rb AS a", "ra AS b")).distinct()
    least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS b", "m")
    return both.join(least.hint("merge"), "b").groupBy("a").agg(F.min(F.expr("least(b, m)")).alias("to")).withColumnRenamed("a", "root")


def moved(rows: DataFrame, to: DataFrame) -> DataFrame:
    """The rows with ``root`` replaced where (root, to) has another one."""
    named = F.coalesce("to", "root").alias("root")
    return rows.join(to.hint("merge"), "root", "left").select(*(named if c == "root" else c for c in rows.columns))


def both(kmers: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The labelled k-mers and the set; the first occurrence of a k-mer has the same value in both."""
    own = np.frombuffer(kmers.as_buffer(), np.uint32).astype(np.uint64)
    plain = np.unique(own)
    return (mix(plain),) * 2 if len(plain) == len(own) else (labelled(own), mix(plain))


def slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def counted(stored: DataFrame) -> np.ndarray:
    """In how many nodes the k-mers of each slot occur, 255 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [slot(np.union1d(*both(x))) for x in batch.column("kmers")]
            at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *slots]), return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)
            cut = np.flatnonzero(np.diff(at // BLOCK, prepend=-1))
            low = (at % BLOCK).astype(np.uint16)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array((at // BLOCK)[cut]),
                    "low": pa.array([x.tobytes() for x in np.split(low, cut[1:])][: len(cut)], pa.binary()),
                    "n": pa.array([x.tobytes() for x in np.split(n, cut[1:])][: len(cut)], pa.binary()),
                }
            )

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in groups:
            for block, low, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total = held.setdefault(block, np.zeros(BLOCK, np.uint8))
                at = np.frombuffer(low, np.uint16)
                total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(n, np.uint8), 255)
        blocks_ = sorted(held)
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array(blocks_, pa.int64()), "n": pa.array([held[b].tobytes() for b in blocks_], pa.binary())}
        )

    parts = stored.select("kmers").mapInArrow(run, "block bigint, low binary, n binary")
    total = np.zeros(SLOTS, np.uint8)
    for row in parts.repartition("block").mapInArrow(add, "block bigint, n binary").collect():
        total[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.n, np.uint8)
    return total


def prefixes(rows: DataFrame, stored: DataFrame, share: float) -> DataFrame:
    """(token, node, root, n, i, m, j): every node of (node, root) by the rarest of its labelled k-mers (the ``i``-th of
    ``n``) and of its k-mer set (the ``j``-th of ``m``); a place is null where the k-mer is not among them.

    Two linked texts share at least ``share`` of the k-mers of either, labelled ones or set, so in any order of all
    k-mers they share one of the first n - ceil(share * n) + 1 of both. K-mers that only one node has meet nothing and
    are not listed.
    """
    counts = rows.sparkSession.sparkContext.broadcast(counted(stored))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = counts.value

        def first(tokens: np.ndarray) -> np.ndarray:
            order = np.lexsort((tokens, number[slot(tokens)]))
            return tokens[order[: len(tokens) - int(np.ceil(share * len(tokens) - 1e-9)) + 1]]

        for batch in batches:
            for x in range(batch.num_rows):
                many, plain = both(batch.column("kmers")[x])
                listed = {}
                for kind, tokens in enumerate((many, plain)):
                    for place, token in enumerate(first(tokens).tolist()):
                        listed.setdefault(token, [None, None])[kind] = place
                tokens = np.array(list(listed), np.uint64)
                keep = number[slot(tokens)] > 1
                tokens, places = tokens[keep], [p for p, k in zip(listed.values(), keep) if k]
                at = pa.array(np.full(len(tokens), x))
                yield pa.RecordBatch.from_pydict(
                    {
                        "token": pa.array(tokens.view(np.int64)),
                        "node": batch.column("node").take(at),
                        "root": batch.column("root").take(at),
                        "n": pa.array(np.full(len(tokens), len(many), np.int32)),
                        "i": pa.array([p[0] for p in places], pa.int32()),
                        "m": pa.array(np.full(len(tokens), len(plain), np.int32)),
                        "j": pa.array([p[1] for p in places], pa.int32()),
                    }
                )

    held = rows.join(stored.select("node", "kmers").hint("merge"), "node")
    return written(held.mapInArrow(run, "token bigint, node binary, root binary, n int, i int, m int, j int"), "prefixes")


def prefix_pairs(listed: DataFrame, share: float) -> DataFrame:
    """(a, b, ra, rb): nodes of different roots that meet in ``prefixes``, unless sizes and places rule a link out.

    The first k-mer that two nodes share stands before all others that they share, so they share no more than one and
    what is behind it in the shorter rest.
    """
    counts = listed.groupBy("token", "root").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("token").agg(F.expr("max_by(root, struct(c, root))").alias("top"), F.count("*").alias("roots")).where("roots > 1")
    held = listed.join(mixed.drop("roots").hint("merge"), "token")
    # nodes of the largest root of a k-mer need not meet one another
    one = held.where("root <> top").selectExpr("token", "node AS a", "root AS ra", "n AS na", "i AS ia", "m AS ma", "j AS ja")
    two = held.selectExpr("token", "node AS b", "root AS rb", "n AS nb", "i AS ib", "m AS mb", "j AS jb", "root = top AS of_top")
    needed = lambda x, y: f"{share / (1 + share)} * ({x} + {y}) - 1e-6"
    close = f"coalesce(least(na - ia, nb - ib) >= {needed('na', 'nb')}, false) OR coalesce(least(ma - ja, mb - jb) >= {needed('ma', 'mb')}, false)"
    met = one.join(two.hint("merge"), "token").where(f"ra <> rb AND (of_top OR a > b) AND ({close})")
    met = met.selectExpr("greatest(a, b) AS a", "least(a, b) AS b", "if(a > b, ra, rb) AS ra", "if(a > b, rb, ra) AS rb")
    return met.distinct()


def with_hubs(rows: DataFrame) -> DataFrame:
    """(band, node, root, hub, hub_root) of (band, node, root): bands with nodes of several roots, and their hubs.

    The hub has the largest ``mass``: the nodes that it meets in all its bands. A band takes the best hub of all bands
    that its nodes are in, so copies of one text get one hub even where a band has only copies.
    """
    sizes = rows.groupBy("band").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    held = written(rows.join(sizes.where("low <> high").select("band", "size").hint("merge"), "band"), "bands")
    mass = written(held.groupBy("node").agg(F.sum("size").alias("mass")), "mass")
    best = held.join(mass.hint("merge"), "node").groupBy("band").agg(F.max(F.struct("mass", "node", "root")).alias("h"))
    best = written(best, "hubs")
    seen = held.join(best.hint("merge"), "band").groupBy("node").agg(F.max("h").alias("h"))
    best = held.join(seen.hint("merge"), "node").groupBy("band").agg(F.max("h").alias("h"))
    best = best.selectExpr("band", "h.node AS hub", "h.root AS hub_root")
    return written(held.join(best.hint("merge"), "band"), "bands")


def small_pairs(rows: DataFrame, near: DataFrame, share: float) -> DataFrame:
    """(a, b, ra, rb): pairs of nodes of a band and of different roots, unless their distances to the hub rule a link out."""
    distance = near.selectExpr("a AS node", "b AS hub", "jaccard AS j", "bound AS l")
    rows = rows.where("node <> hub").join(distance.hint("merge"), ["node", "hub"], "left")
    one = rows.selectExpr("band", "node AS a", "root AS ra", "j AS ja", "l AS la")
    two = rows.selectExpr("band", "node AS b", "root AS rb", "j AS jb", "l AS lb")
    close = f"coalesce(least(abs(ja - jb), abs(la - lb)) <= {1 - share} + 1e-9, true)"
    return one.join(two.hint("merge"), "band").where(f"a > b AND ra <> rb AND {close}").select("a", "b", "ra", "rb").distinct()


def open_bands(rows: DataFrame) -> DataFrame:
    """The rows of bands whose nodes are of several roots, with ``few``: whether a node has at most ``SMALL`` others of
    another root in the band, on average."""
    counts = rows.groupBy("band", "root").agg(F.count("*").alias("n"))
    split = counts.groupBy("band").agg(F.count("*").alias("roots"), F.sum("n").alias("all"), F.sum(F.expr("double(n) * n")).alias("same"))
    split = split.where("roots > 1").selectExpr("band", f"double(all) * all - same <= {SMALL}D * all AS few")
    return rows.drop("few").join(split.hint("merge"), "band")


def drawn_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b, ra, rb): every node of (band, node, root) with nodes drawn from all but the largest root of its band."""
    counts = rows.groupBy("band", "root").agg(
        F.count("*").alias("n"), *(F.expr(f"min_by(node, xxhash64(node, {turn}, {i}))").alias(f"p{i}") for i in range(PIVOTS))
    )
    picked = [F.expr(f"min_by(struct(p{i} AS node, root), struct(root = top, xxhash64(p{i}, {turn}, {i})))").alias(f"q{i}") for i in range(PIVOTS)]
    largest = counts.groupBy("band").agg(F.expr("max_by(root, struct(n, root))").alias("top"), F.count("*").alias("roots")).where("roots > 1")
    drawn = counts.join(largest.hint("merge"), "band").groupBy("band").agg(*picked)
    pivots = F.explode(F.array_distinct(F.array(*(f"q{i}" for i in range(PIVOTS)))))
    pairs = rows.join(drawn.hint("merge"), "band").select(F.struct("node", "root").alias("q"), pivots.alias("p")).where("q.root <> p.root")
    pairs = pairs.selectExpr("greatest(q, p) AS q", "least(q, p) AS p").selectExpr("q.node AS a", "p.node AS b", "q.root AS ra", "p.root AS rb")
    return pairs.distinct()


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    k: int = K,
    share: float = SIMILARITY,
    keep: int = KEEP,
    rows: int = ROWS,
    number: int = BANDS,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``class_id`` (the smallest id of its class) and ``class_size`` (rows).

    Linked are texts whose k-mers align, in order, to at least ``share`` of all their k-mers, or whose k-mer sets have
    that Jaccard similarity. Texts with equal words are always of one class. A text without words (null, empty, marks
    only) is a class of its own; a text of at most k words has only its equals.
    """
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    sketched = written(sketches(source, k, keep, rows, number), "sketches")
    named = sketched.where("node IS NOT NULL")
    groups = written(
        named.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.any_value("bands").alias("bands")), "nodes"
    )

    banded = groups.select(F.explode("bands").alias("band"), "node", F.col("node").alias("root"))
    rows_ = with_hubs(banded)
    hubs = rows_.select(F.col("hub").alias("node")).distinct().withColumn("is_hub", F.lit(True))
    wanted = groups.select("node", F.col("first_id").alias("id")).join(rows_.select("node").distinct().hint("merge"), "node")
    stored = stored_kmers(source, wanted.join(hubs.hint("merge"), "node", "left").select("node", "id", F.expr("is_hub IS NOT NULL AS is_hub")), k)

    stars = rows_.where("root <> hub_root").selectExpr("node AS a", "hub AS b", "root AS ra", "hub_root AS rb").distinct()
    near = compare(stars, stored, share, hubs=True)
    found = components(near.where("linked").selectExpr("ra AS a", "rb AS b"))
    rows_ = written(open_bands(moved(rows_, found.selectExpr("node AS root", "root AS to"))), "open")
    links = [compare(small_pairs(rows_.where("few"), near, share), stored, share).where("linked").select("ra", "rb")]
    rows_ = rows_.where("NOT few").drop("few")
    if not rows_.isEmpty():
        stored = written(stored.join(rows_.select("node").distinct().hint("merge"), "node", "left_semi"), "held")
        # draws compare a node in its largest band only; the prefix join finds what they leave open
        now = rows_.groupBy("node", "root").agg(F.max(F.struct("size", "band"))["band"].alias("band"))
        while True:
            now = written(open_bands(moved(now, lowered(links[-1]))).drop("few"), "large")
            drawn = compare(drawn_pairs(now, len(links)), stored, share)
            links.append(drawn.where("linked").select("ra", "rb"))
            linked, pairs = drawn.selectExpr("count_if(linked)", "count(*)").head()
            if linked <= WORTH * pairs:
                break
        rows_ = moved(rows_.select("node", "root").distinct(), lowered(reduce(DataFrame.union, links)))
        pairs = prefix_pairs(prefixes(rows_, stored, share), share)
        links.append(compare(pairs, stored, share).where("linked").select("ra", "rb"))
    joined = components(reduce(DataFrame.union, links).selectExpr("ra AS a", "rb AS b")).selectExpr("node AS root", "root AS to")
    placed = groups.select("node", "first_id", "n").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = moved(placed, joined)
    classes = placed.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size")).where("class_size > 1")
    known = placed.join(classes, "root").select("node", "class_id", "class_size")
    return sketched.select("id", "node").join(known, "node", "left").select(
        F.col("id").alias(id),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )
