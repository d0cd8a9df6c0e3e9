"""Toxicity of texts after undoing disguises.

A disguised word (``1d10t``, ``i d i o t``, ``idiooot``) is a lattice: every character stands for itself, for a letter
that it is written for, for nothing (a separator) or for fewer repeats. Viterbi decoding takes the path that a
character trigram model of the corpus finds most likely. The model counts all documents.

Words, their beginnings, and the restored words are features, told apart by their full 64-bit hashes: a feature that no
training text holds is never taken for another one. Features that stand for the label in labelled
documents - nine tenths of their texts are labelled toxic, at least half by a lower confidence bound - are combined by a
noisy-or.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.words import BASE, LOWER, WEIGHT, blocks, mix, powers, text_bytes, words_of

TRAIN_ROWS = 50_000
BEGINNINGS = (4, 5, 6)
CONFIDENCE = 3.0
SHARE = 0.9
CODES = 32

# Letters that a character may be written for, and the cost of each reading.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
READING = 0.4
DOUBLE, SINGLE = 1.5, 0.5

TOKEN = re.compile(r"[^\s\"'(),;:.?]*[0-9@$!|+][^\s\"'(),;:.?]*")
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]){3,}[^\W_](?![^\W_])")
REPEATED = re.compile(r"[^\W_]*([^\W\d_])\1\1[^\W_]*")
INNER = re.compile(r"[^\W\d_][0-9@$!|+]+[^\W\d_]|[0-9@$!|+][^\W\d_]|[^\W\d_][0-9@$|+]")


def code(c: str) -> int:
    """0: no letter, 1 to 26: a to z, others by their code point."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 5 if c.isalpha() else 0


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): character trigrams of all texts, counted in each task and summed."""

    table = np.zeros(256, np.int64)
    for b in range(256):
        table[b] = code(chr(b).lower()) if b < 128 else 27 + b % 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CODES**3, np.int64)
        for batch in batches:
            for block in blocks(batch, "text"):
                data, _ = text_bytes(block.column("text"))
                data = data[(data < 0xC0) | (data > 0xDF)]  # of two-byte letters, the second counts
                if len(data) < 3:
                    continue
                c = table[data]
                counts += np.bincount(c[:-2] * CODES * CODES + c[1:-1] * CODES + c[2:], minlength=CODES**3)
        grams = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(grams), "n": pa.array(counts[grams])})

    return docs.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def log_probabilities(grams: list[tuple[int, int]]) -> np.ndarray:
    """Trigram model, smoothed by the bigram model and that by the character shares."""
    three = np.zeros(CODES**3)
    for gram, n in grams:
        three[gram] = n
    three = three.reshape(CODES, CODES, CODES)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + CODES)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3)


class Decoder:
    """Restores disguised words; remembers at most ``keep`` of them."""

    def __init__(self, log_p: np.ndarray, keep: int = 50_000):
        self.log_p = log_p.tolist()
        self.keep = keep
        self.known: dict[str, str] = {}

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        out = []
        for c, run in groupby(word):
            n = sum(1 for _ in run)
            letters = LEET.get(c, c if c.isalpha() else "")
            cost = READING if c in LEET else 0.0
            if not letters:
                out.append([("", 0.0)])
            elif n == 1:
                out.append([(x, cost) for x in letters])
            else:
                out.append([(x, cost + SINGLE) for x in letters] + [(x * 2, cost + (0.0 if n == 2 else DOUBLE)) for x in letters])
        return out

    def restore(self, word: str) -> str:
        """The likeliest reading between two word ends."""
        if word in self.known:
            return self.known[word]
        log_p = self.log_p
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self.lattice(word):
            step: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in best.items():
                for letters, cost in options:
                    s, x, y = score - cost, a, b
                    for c in letters:
                        z = code(c)
                        s += log_p[x][y][z]
                        x, y = y, z
                    if (x, y) not in step or s > step[x, y][0]:
                        step[x, y] = (s, text + letters)
            best = step
        found = max((s + log_p[a][b][0], t) for (a, b), (s, t) in best.items())[1]
        if len(self.known) >= self.keep:
            self.known.clear()
        self.known[word] = found
        return found

    def restored(self, text: str) -> list[str]:
        """Readings of all disguised words of a text."""
        text = text.lower()
        out = []
        for m in TOKEN.finditer(text):
            word = m[0].strip("!|+*%&#<>[]{}=~")
            if INNER.search(word):
                out.append(self.restore(word))
        for pattern in (SPELLED, REPEATED):
            out += [self.restore(m[0]) for m in pattern.finditer(text)]
        return out


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may hold a disguised word: a letter beside a sign of ``LEET``, three equal letters, spelled words."""
    if not len(data):
        return np.zeros(len(offsets) - 1, bool)
    low = LOWER[data]
    letter = (WEIGHT[data] != 0) & ~((data >= 48) & (data <= 57))
    sign = np.isin(data, np.frombuffer("".join(LEET).encode(), np.uint8))
    mark = np.zeros(len(data), bool)
    mark[1:] |= (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
    mark[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    word = WEIGHT[data] != 0
    gap = np.isin(data, np.frombuffer(b" .-_*", np.uint8))
    mark[5:] |= gap[5:] & word[4:-1] & gap[3:-2] & word[2:-3] & gap[1:-4] & word[:-5]
    total = np.concatenate([[0], np.cumsum(mark)])
    return total[offsets[1:]] > total[offsets[:-1]]


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word and of the beginnings of longer words."""
    data, starts, ends, hashes, first = words_of(column)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    up = powers(BASE, max(BEGINNINGS))
    owners, found = [owner], [hashes]
    for size in BEGINNINGS:
        long = np.flatnonzero(ends - starts > size)
        value = np.full(len(long), size, np.uint64)
        for j in range(size):
            value += WEIGHT[data[starts[long] + j]] * up[j]
        owners.append(owner[long])
        found.append(mix(value + np.uint64(size)))
    return np.concatenate(owners), np.concatenate(found).view(np.int64)


def features(block: pa.RecordBatch, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of words as they stand and as they were restored, with repeats."""
    column = block.column("text")
    owner, feature = hashed(column)
    flagged = np.flatnonzero(suspicious(*text_bytes(column)))
    if len(flagged):
        words = [" ".join(decoder.restored(t or "")) for t in column.take(pa.array(flagged)).to_pylist()]
        more, extra = hashed(pa.array(words, pa.string()))
        owner, feature = np.concatenate([owner, flagged[more]]), np.concatenate([feature, extra])
    return owner, feature


def feature_counts(rows: DataFrame, log_p: np.ndarray) -> DataFrame:
    """(feature, toxic, other) of (text, toxic): texts that hold the feature, counted in blocks and summed; the row
    without a feature counts all texts.

    Of texts with the same smallest beginning of five words only one counts, so a group of copies is one example.
    """
    shared = rows.sparkSession.sparkContext.broadcast(log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for block in blocks(batch, "text"):
                toxic = block.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                owner, feature = features(block, decoder)
                order = np.lexsort((owner, feature))
                owner, feature = owner[order], feature[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
                seen, at = np.unique(feature[new], return_inverse=True)
                of = [np.bincount(at, weights=toxic[owner[new]] == y, minlength=len(seen)).astype(np.int64) for y in (1, 0)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "feature": pa.concat_arrays([pa.array(seen, pa.int64()), pa.nulls(1, pa.int64())]),
                        "toxic": pa.array(np.append(of[0], (toxic == 1).sum())),
                        "other": pa.array(np.append(of[1], (toxic == 0).sum())),
                    }
                )

    return rows.mapInArrow(run, "feature bigint, toxic bigint, other bigint").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    )


def signed(rows: DataFrame) -> DataFrame:
    """(text, toxic) with one row for each smallest hash of five words."""
    from volpanel.llm.near_duplicates import kmers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                _, _, _, hashes, first = words_of(block.column("text"))
                values, at = kmers(hashes, first, 5)
                full = np.flatnonzero(np.diff(at) > 0)
                least = np.zeros(block.num_rows, np.uint64)
                if len(full):
                    least[full] = np.minimum.reduceat(values, at[:-1][full])
                yield pa.RecordBatch.from_pydict({"sign": pa.array(least.view(np.int64)), "text": block.column("text"), "toxic": block.column("toxic")})

    marked = rows.mapInArrow(run, "sign bigint, text string, toxic int")
    return marked.groupBy("sign", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(counts: list[tuple[int | None, int, int]], confidence: float = CONFIDENCE) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of toxic texts without any feature, and the features in use, in order, with their strengths."""
    total = next(((t, o) for f, t, o in counts if f is None), (0, 0))
    base = total[0] / max(sum(total), 1)
    strength = {}
    for feature, toxic, other in counts:
        if feature is None:
            continue
        n = toxic + other
        z2 = confidence**2
        share = toxic / n
        low = (share + z2 / (2 * n) - confidence * math.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
        if low >= 0.5 and share >= SHARE:
            strength[feature] = low
    used = np.array(sorted(strength), np.int64)
    return min(base, 0.25), used, np.array([strength[f] for f in used.tolist()], np.float64)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: held_out, score (0 to 1) and predicted (score >= 0.5).

    Labels of rows whose ``crc32(id as text) mod 5`` is 0 are never learned from (held out). At most about
    ``train_rows`` other labelled rows, chosen by a hash of the id, fit the classifier; character counts are taken over
    all documents. Null and empty texts get the base score; without labels every score is 0.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    held = "coalesce(pmod(crc32(string(id)), 5) = 0, false)"
    log_p = log_probabilities([tuple(r) for r in trigram_counts(source.select("text")).collect()])
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("toxic")).where(f"toxic IN (0, 1) AND id IS NOT NULL AND NOT {held}")
    many = known.count()
    chosen = known.where(f"pmod(xxhash64(id), {max(1, -(-many // train_rows))}) = 0").dropDuplicates(["id", "toxic"])
    train = source.join(F.broadcast(chosen), "id").select("text", "toxic")
    # with fewer texts than this, no share has a lower bound of one half
    least = math.ceil(CONFIDENCE**2)
    counts = feature_counts(signed(train), log_p).where(f"feature IS NULL OR (toxic >= {least} AND toxic >= {SHARE} * (toxic + other))").toArrow()
    base, used, strength = fit(list(zip(*(counts.column(c).to_pylist() for c in ("feature", "toxic", "other")))))
    shared = spark.sparkContext.broadcast((log_p, base, used, strength))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p, base, used, strength = shared.value
        decoder = Decoder(log_p)
        loss = np.log1p(-np.minimum(strength, 0.999))
        for batch in batches:
            for block in blocks(batch, "text"):
                owner, feature = features(block, decoder)
                at = np.searchsorted(used, feature)
                there = np.flatnonzero(at < len(used))
                there = there[used[at[there]] == feature[there]]
                key = np.unique(owner[there] * max(len(used), 1) + at[there])
                clean = np.bincount(key // max(len(used), 1), weights=loss[key % max(len(used), 1)], minlength=block.num_rows)
                score = 1 - (1 - base) * np.exp(clean)
                yield pa.RecordBatch.from_pydict({"id": block.column("id"), "score": pa.array(score)})

    scored = source.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.expr(held).alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted"), F.col("id").alias(id)).select(
        id, "held_out", "score", "predicted"
    )
