"""Spelling variants, hard negatives and nearest neighbours against brute force, and their edge cases."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np

from volpanel.llm.hard_negatives import Columns, by_dimension, for_windows, hard_negatives
from volpanel.llm.spelling import prefixes, runs_of, spelling_variants
from volpanel.llm.vantage import NODE, Search, build_tree, nearest
from volpanel.llm.vectors import finite

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- spelling variants


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, every, least_length, least_count, factor=5):
    counts = collections.Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words[form[w]] if form[w] else None, root)
    return out


def run_variants(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spelling_variants(docs, **options).collect()
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in found}


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    rows = [(i if i % 9 else None, " ".join(rng.choices(stems, weights=range(1, 61), k=80)).title()) for i in range(60)]
    rows += [(1, None), (2, ""), (3, "1 2 3"), rows[5], rows[5]]
    for every, length, count in ((7, 2, 1), (0, 3, 2), (199, 6, 5)):
        got = run_variants(spark, rows, every=every, least_length=length, least_count=count, factor=2)
        assert got == plain_variants(rows, every, length, count, factor=2)
    assert run_variants(spark, rows[:0] or [(1, None)]) == {}


def test_very_long_words_and_chains_of_forms(spark):
    long = "ab" * 3000
    words = [long] * 50 + [long[:-1]] * 10 + [long[:3000] + "x" + long[3001:]] * 5 + ["chains"] * 200 + ["chain"] * 40 + ["chais"] * 7 + ["haisss"]
    rows = [(i, w) for i, w in enumerate(words)]
    got = run_variants(spark, rows, every=0, least_length=5, least_count=5)
    assert got == plain_variants(rows, 0, 5, 5)
    assert got["chais"][4] == "chains" and got[long[:-1]][2] == long


def test_prefixes_of_words_meet_once_for_each_edit():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(120)})
    groups = collections.defaultdict(list)
    for w in words:
        for key, longer, once in prefixes(w, head=4):
            groups[key].append((w, longer, once))
    met = collections.Counter()
    for rows in groups.values():
        for (a, la, oa), (b, lb, ob) in itertools.combinations(rows, 2):
            if a != b and (la and lb or la != lb and oa and ob):
                met[min(a, b), max(a, b)] += 1
    assert met == collections.Counter({(a, b): 1 for a, b in itertools.combinations(words, 2) if one_apart(a, b)})


def test_a_shortened_run_counts_as_what_is_left():
    prefix = next(p for p in (f"{i}:" for i in range(10_000)) if not zlib.crc32(f"{p}word".encode()) % 5)
    cut = zlib.crc32(f"{prefix}word".encode()) % 4
    assert runs_of("Word word", prefix.encode(), 5) == {"word"[:cut] + "word"[cut + 1 :]: 2}


# ---- vectors

ODD = [(None, [1.0, 2.0], 1), (7, None, 1), (8, [], 2), (9, [1.0, None], 1), (10, [float("nan"), 1.0], 1), (11, [float("inf"), 1.0], 1)]
VECTORS = "vec_id long, embedding array<double>, label int, id string, key int, block string, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], VECTORS)


def plain_nearest(rows, queries, number=10):
    good = [(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, v in {g for g in good if g[0] in queries}:
        d = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w))), j) for j, w in good if j != i and len(w) == len(v))
        out |= {(i, n + 1, j, round(s, 9)) for n, (s, j) in enumerate(d[:number])}
    return out


def sample_rows():
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8], int(rng.integers(0, 3))) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.125], 0) for i in range(200)]  # copies
    rows += [(1200, [0.0] * 6, 1), (1300, [0.5, 0.25], 1), (1301, [0.5, 0.5], 1), (1302, [0.25, 0.25], 2)] + [rows[0], rows[1], (0, [1.0] * 6, 2)]
    return rows + ODD


def test_exact_search_equals_brute_force(spark):
    rows = sample_rows()
    table = vectors(spark, rows).repartition(3)
    for shard, block in ((4096, 256), (70, 3)):
        found = nearest(table, table.where("vec_id % 100 = 0"), shard=shard, block=block)
        got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found.collect()}
        assert got == plain_nearest(rows, {r[0] for r in rows if r[0] is not None and r[0] % 100 == 0})
    assert nearest(table.limit(0), table.where("vec_id % 100 = 0")).count() == 0
    assert nearest(table, table.limit(0)).count() == 0


def test_a_smaller_factor_compares_less_and_loses_little():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    vectors_ = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.15
    order, nodes = build_tree(vectors_)
    assert nodes.shape[1] == len(NODE) and sorted(order) == list(range(4000))
    queries, compared, recall = vectors_[:200], [], []
    truth = [set(np.argsort(((vectors_ - q) ** 2).sum(axis=1), kind="stable")[1:11]) for q in queries]
    for factor in (1.0, 0.7, 0.4):
        search = Search(vectors_[order], order, nodes, queries, np.arange(200), 10, factor)
        _, who = search.run()
        compared.append(search.compared)
        recall.append(np.mean([len(t & set(w)) / 10 for t, w in zip(truth, who)]))
    assert recall[0] == 1.0 and recall[1] >= 0.9
    assert compared[0] > compared[1] > compared[2] and compared[0] < 200 * 4000 / 3


def plain_negatives(rows, anchors, share=80):
    good = [
        (i, k, tuple(math.floor(256 * x) for x in v))
        for i, v, k in rows
        if i is not None and k is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for i, k, v in {g for g in good if g[0] in anchors}:
        score = lambda w: sum(x * y for x, y in zip(v, w))
        fit = [g for g in good if len(g[2]) == len(v)]
        positives = sorted((-score(w), j) for j, m, w in fit if m == k and j != i)[:5]
        for p, j in positives:
            far = sorted((-score(w), n) for n, m, w in fit if m != k and share * -p <= 100 * score(w) <= 100 * -p)[:5]
            out |= {(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(far)}
    return out


def test_hard_negatives_equal_brute_force(spark):
    rows = sample_rows() + [(500, [0.5] * 6, None), (600, [-1.0] * 6, 0)]
    table = vectors(spark, rows).repartition(3)
    for shard, block in ((4096, 256), (70, 3)):
        found = hard_negatives(table, table.where("vec_id % 100 = 0"), shard=shard, block=block)
        assert {tuple(r) for r in found.collect()} == plain_negatives(rows, {r[0] for r in rows if r[0] is not None and r[0] % 100 == 0})
    assert hard_negatives(table.limit(0), table).count() == 0
    assert hard_negatives(table, table.limit(0)).count() == 0


def test_bounds_shut_rows_out_before_the_last_column():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    values = rng.integers(-100, 100, (3000, 32))
    table = by_dimension(pa.table({"id": np.arange(3000), "label": np.zeros(3000, np.int64), "vector": pa.array(list(values))}))
    columns, seen = Columns(table), []
    exact = values @ values[5]
    limit = int(np.sort(exact)[-30])
    bounds = for_windows([(limit, int(exact.max()))], 5)

    def useful(low, high):
        seen.append(len(low))
        return bounds(low, high)

    rows, scores = columns.scan(values[5], np.arange(3000), useful)
    assert (exact[rows] == scores).all() and set(np.argsort(-exact)[:5]) <= set(rows)
    assert seen[0] == 3000 and seen[-1] < 100


def test_finite_in_sql(spark):
    table = vectors(spark, ODD + [(1, [0.0], 1)])
    assert [r[0] for r in table.where(finite("embedding")).select("vec_id").collect()] == [None, 1]
