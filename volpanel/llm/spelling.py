"""Groups of spelling variants by permuterm rotations.

Every word is closed by a mark and turned to begin at each of its characters. Two words differ by one replaced
character if and only if a rotation of one and a rotation of the other, each ending with the character in question,
are equal but for that last character; a word lacks one character of another if and only if a whole rotation of it is
such a shortened rotation of the other. So rotations are sorted by the prefix that skips the edited character, and words
whose prefixes are equal stand together. The last character tells the words of such a group apart, so it holds at
most one word for each letter of the alphabet and the one that lacks it, whatever the size of the corpus.

A prefix is kept as its first characters and a digest of the whole, so a word takes room in proportion to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.vectors import written
from volpanel.llm.words import blocks

# Fixed value: letters of a word.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MARK = "$"
HEAD = 64
#: Prefixes are hashed as polynomials of this base modulo this prime.
BASE, PRIME = 0x2545F4914F6CDD1D9E3779B97F4A7C15, (1 << 127) - 1
EVERY = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
#: Words counted in a task before they are passed on.
HELD = 500_000


def runs_of(text: str, prefix: bytes, every: int = EVERY) -> Counter:
    """Lower-cased runs of letters and how often each stands in the text; a run whose checksum after ``prefix``
    ``every`` divides loses a character."""
    found = Counter(RUN.findall(text.translate(LOW)))
    start = crc32(prefix)
    changed = [(run, h) for run in found if every and not (h := crc32(run.encode(), start)) % every]
    shorter = [(run[: h % len(run)] + run[h % len(run) + 1 :], found.pop(run)) for run, h in changed]
    for run, n in shorter:
        found[run] += n
    return found


def count_words(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of (id, text): words of at least ``least_length`` code points that stand ``least_count`` times in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        room = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in batches:
            for block in blocks(batch, "text"):
                for id, text in zip(block.column("id").to_pylist(), block.column("text").to_pylist()):
                    for word, n in runs_of(text or "", f"{'' if id is None else id}:".encode(), every).items():
                        if len(word) >= least_length:
                            if word not in counts:
                                room += 100 + len(word)
                            counts[word] += n
                    if len(counts) >= HELD or room >= 100 * HELD:
                        yield out()
                        counts.clear()
                        room = 0
        yield out()

    counted = docs.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(f"n >= {least_count}")


def prefixes(word: str, head: int = HEAD) -> Iterator[tuple[str, bool, bool]]:
    """(prefix, longer, counts): for each character the rotation that ends with it, without it, and then all whole
    rotations (not ``longer``). ``counts`` is false where the character before is the same: leaving out either of the
    two gives the same shorter word, which is to be found once."""
    size = len(word)
    hashes, power = [0], [1]
    for c in word:
        hashes.append((hashes[-1] * BASE + ord(c) + 1) % PRIME)
        power.append(power[-1] * BASE % PRIME)

    def key(behind: int, before: int) -> str:
        """Of word[behind:], the mark, and word[:before]."""
        n = size - behind + 1 + before
        text = word[behind : behind + head] + MARK + word[: min(before, head)]
        if n <= head:
            return text
        value = (hashes[size] - hashes[behind] * power[size - behind]) * BASE + ord(MARK) + 1
        value = (value * power[before] + hashes[before]) % PRIME
        return f"{text[:head]}{value:032x}{n}"

    for i in range(size):
        yield key(i + 1, i), True, i == 0 or word[i] != word[i - 1]
    for i in range(size + 1):
        yield key(i, i), False, True


def neighbours(words: DataFrame) -> DataFrame:
    """(id, near_id, near_n): every two of the (id, word, n) that one inserted, deleted or replaced character parts."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, counts, longer, once = [], [], [], [], []

            def out() -> pa.RecordBatch:
                columns = (keys, ids, counts, longer, once)
                made = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["prefix", "id", "n", "longer", "once"])
                for c in columns:
                    c.clear()
                return made

            for id, word, n in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for key, more, first in prefixes(word):
                    keys.append(key)
                    ids.append(id)
                    counts.append(n)
                    longer.append(more)
                    once.append(first)
                    if len(keys) == 50_000:
                        yield out()
            if keys:
                yield out()

    rotations = words.mapInArrow(rotate, "prefix string, id bigint, n bigint, longer boolean, once boolean")
    # at most one row for each letter of the alphabet, and the word that lacks it
    groups = rotations.repartitionByRange("prefix").groupBy("prefix").agg(F.collect_list(F.struct("id", "n", "longer", "once")).alias("rows"))
    pairs = groups.where("size(rows) > 1").select(F.explode("rows").alias("a"), "rows").select("a", F.explode("rows").alias("b"))
    pairs = pairs.where("a.id <> b.id AND (a.longer AND b.longer OR a.longer <> b.longer AND a.once AND b.once)")
    return pairs.selectExpr("a.id AS id", "b.id AS near_id", "b.n AS near_n")


def spelling_variants(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    every: int = EVERY,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    factor: int = FACTOR,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of the texts.

    Words are runs of letters with A-Z lower-cased, of at least ``least_length`` code points and ``least_count``
    places. Of those that one inserted, deleted or replaced code point parts from a word, ``n_near`` is the number and
    ``form`` the most frequent one (ties: the smallest in code-point order), if it is at least ``factor`` times as
    frequent as the word; ``root`` follows the forms to the last one. ``every``: a run loses a code point if the CRC-32
    of id, colon and run is a multiple of it (0: never); a null id is an empty one. Null and empty texts have no
    words; a row that repeats another counts again.
    """
    kept = docs.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    # ids follow the order of the words
    ordered = count_words(kept, every, least_length, least_count).orderBy("word").selectExpr("monotonically_increasing_id() AS id", "word", "n")
    words = written(ordered, "words")
    chosen = neighbours(words).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.expr("struct(-near_n AS n, near_id AS id)")).alias("first"))
    placed = words.select("id", "n").join(chosen, "id", "left").selectExpr(
        "id", "coalesce(n_near, 0L) AS n_near", f"CASE WHEN -first.n >= {factor} * n THEN first.id END AS form", f"CASE WHEN -first.n >= {factor} * n THEN -first.n END AS form_n"
    )
    placed = written(placed, "forms")
    # a form is ``factor`` times as frequent, so chains are short; each turn doubles the links followed
    roots = placed.where("form IS NOT NULL").selectExpr("id", "form AS root")
    while True:
        further = roots.selectExpr("id AS root", "root AS next")
        moved = written(roots.join(further, "root", "left").selectExpr("id", "coalesce(next, root) AS root", "next IS NOT NULL AS went_on"), "roots")
        roots = moved.select("id", "root")
        if moved.where("went_on").isEmpty():
            break
    form = words.selectExpr("id AS form", "word AS form_word")
    root = words.selectExpr("id AS root", "word AS root_word")
    full = words.join(placed, "id").join(roots, "id", "left").join(form, "form", "left").join(root, "root", "left")
    return full.selectExpr("word", "n", "n_near", "form_word AS form", "form_n", "coalesce(root_word, word) AS root")
