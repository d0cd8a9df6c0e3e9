"""Licence notices in texts, exact and with a bounded number of edits.

Texts are reduced to lower-case words with single blanks between them. A notice of n characters may have ``n // 10``
edits; cut into one piece more than that, at least one piece stands unchanged in every match (pigeonhole). An
automaton over all pieces finds these seeds in one pass. The surroundings of a seed must hold enough short pieces of the
notice (an edit changes at most ``GRAM`` of them) and the words that tell licences apart, which must stand unchanged in a
match: an edit there would turn one licence into another. Only such surroundings are given to the ``regex`` library,
whose bounded-error matching accepts or rejects them and reports where the match stands.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.words import LOWER, blocks, ragged, text_bytes, word_spans

# Phrases that count as they stand, and the short notices that are searched with edits.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "licensed under the creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
# Words that tell one licence from another; versions (digits but 0) do, too. Edits never fall on them.
TELLING = set("mit apache gnu lesser affero mozilla bsd isc creative commons attribution cc by nc sa nd unencumbered".split())
CHARACTERS_PER_EDIT = 10
#: Characters of the short pieces of a notice that are looked for around a seed.
GRAM = 4


def telling(words: str) -> list[str]:
    return [w for w in words.split() if w in TELLING or w.isdigit() and w != "0"]


def seeds_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of about equal length, with their offsets."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def grams(text: str) -> list[str]:
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]


def whole_words(text: str, start: int, end: int) -> str:
    """The words that text[start:end] touches; words never go on behind a blank or a line feed."""
    while start and not text[start - 1].isspace() and not text[start].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace() and not text[end - 1].isspace():
        end += 1
    return text[start:end]


class Notice:
    """A notice, and what a text must hold to match it with at most ``edits`` edits."""

    def __init__(self, words: str, label: str, per_edit: int):
        import regex

        self.words, self.label, self.edits = words, label, len(words) // per_edit
        self.pattern = regex.compile(f"(?b)(?:{regex.escape(words, literal_spaces=True)}){{e<={self.edits}}}")
        self.telling, self.grams = telling(words), grams(words)
        self.least = len(self.grams) - GRAM * self.edits

    def possible(self, text: str, start: int, end: int) -> bool:
        """False only if no match inside text[start:end] could count."""
        there = set(grams(text[start:end]))
        if sum(gram in there for gram in self.grams) < self.least:
            return False
        return set(self.telling).issubset(whole_words(text, start, end).split())


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str], per_edit: int):
        import ahocorasick

        self.base = base
        self.notices = [Notice(words, label, per_edit) for words, label in notices.items()]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(self.notices):
            for offset, piece in seeds_of(notice.words, notice.edits):
                seeds.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def exact(self, text: str) -> Iterator[tuple[int, str]]:
        """Start (of the first word) and label of every place of a base phrase."""
        for phrase, label in self.base.items():
            at = text.find(f" {phrase} ")
            while at >= 0:
                yield at + 1, label
                at = text.find(f" {phrase} ", at + 1)

    def fuzzy(self, text: str) -> Iterator[tuple[int, int, str, int, int]]:
        """Start, end, label, edits and length of the notice of every match, each place of a notice once."""
        tried: dict[int, list[tuple[int, int]]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for number, offset in owners:
                tried.setdefault(number, []).append((end - size + 1 - offset, end))
        for number, starts in tried.items():
            notice = self.notices[number]
            edits, size = notice.edits, len(notice.words)
            done = -1
            last = None
            for start, seed in sorted(starts):
                low, high = max(start - edits, 0, done), start + size + edits
                if start + size <= done:
                    continue
                # the text of the seed: a clipped notice would begin in the text before or end in the next one
                low = max(low, text.rfind("\n", low, max(seed, low)) + 1)
                stop = text.find("\n", max(seed, low), high)
                window = low, stop if stop >= 0 else high
                if window == last:
                    continue
                last = window
                if not notice.possible(text, *window):
                    continue
                found = notice.pattern.search(text, *window)
                if found and found.end() > found.start() and telling(whole_words(text, found.start(), found.end())) == notice.telling:
                    done = found.end()
                    yield found.start(), found.end(), notice.label, sum(found.fuzzy_counts), size


def plain_text(column: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """Words of all texts, " a b c " and a line feed for each text; place of every word, and first word of each text.

    A character of the result is a byte of the text (Latin-1), so places are counted in bytes.
    """
    data, offsets = text_bytes(column)
    starts, ends = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    sizes = ends - starts
    text_of = np.repeat(np.arange(len(column)), np.diff(first))
    at = np.cumsum(sizes) - sizes + np.arange(len(starts)) + 1 + 2 * text_of
    total = int(sizes.sum()) + len(starts) + 2 * len(column)
    out = np.full(total, 32, np.uint8)
    out[ragged(at, sizes)] = LOWER[data[ragged(starts, sizes)]]
    before = np.concatenate([[0], np.cumsum(sizes)])
    out[before[first[1:]] + first[1:] + 2 * np.arange(len(column)) + 1] = 10
    return out.tobytes().decode("latin-1"), at, first


def scan_licences(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    base: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    per_edit: int = CHARACTERS_PER_EDIT,
) -> DataFrame:
    """One row per row of ``docs``: n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are their smallest and largest
    first words (null without one). ``matches`` has label, first word, end word and edits of each notice found, and
    ``score`` is 1 for an exact phrase, else the best share of unchanged characters, else 0. Null and empty texts have
    no words. Phrases are plain lower-case words.
    """
    base = BASE if base is None else base
    notices = NOTICES if notices is None else notices
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, per_edit)
        for batch in batches:
            for block in blocks(batch, "text"):
                plain, at, first = plain_text(block.column("text"))
                rows: list[dict] = [
                    {"n_base": 0, "first_word": None, "last_word": None, "base": set(), "all": set(), "score": 0.0, "matches": []}
                    for _ in range(block.num_rows)
                ]
                for start, label in scanner.exact(plain):
                    word = int(np.searchsorted(at, start))
                    k = int(np.searchsorted(first, word, side="right")) - 1
                    row, word = rows[k], word - int(first[k])
                    row["n_base"] += 1
                    row["first_word"] = word if row["first_word"] is None else min(row["first_word"], word)
                    row["last_word"] = word if row["last_word"] is None else max(row["last_word"], word)
                    row["base"].add(label)
                    row["score"] = 1.0
                taken: list[tuple[int, int]] = []
                for start, end, label, edits, size in sorted(scanner.fuzzy(plain), key=lambda m: (m[3] / m[4], -m[4], m[0])):
                    # of notices that overlap, the one with fewer edits stays
                    near = bisect_left(taken, (start, end))
                    if any(a < end and start < b for a, b in taken[max(near - 1, 0) : near + 1]):
                        continue
                    insort(taken, (start, end))
                    word = max(int(np.searchsorted(at, start, side="right")) - 1, 0)
                    last = int(np.searchsorted(at, end - 1, side="right"))
                    if plain[start] == " ":
                        word += 1
                    k = int(np.searchsorted(first, min(word, last - 1), side="right")) - 1
                    row = rows[k]
                    row["all"].add(label)
                    row["score"] = max(row["score"], 1 - edits / size)
                    row["matches"].append({"label": label, "first_word": word - int(first[k]), "end_word": last - int(first[k]), "edits": edits})
                take = lambda name, kind: pa.array([r[name] for r in rows], kind)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": block.column("id"),
                        "n_words": pa.array(np.diff(first)),
                        "n_base": take("n_base", pa.int64()),
                        "first_word": take("first_word", pa.int64()),
                        "last_word": take("last_word", pa.int64()),
                        "base_labels": pa.array([",".join(sorted(r["base"])) for r in rows], pa.string()),
                        "labels": pa.array([",".join(sorted(r["base"] | r["all"])) for r in rows], pa.string()),
                        "score": take("score", pa.float64()),
                        "matches": take(
                            "matches",
                            pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])),
                        ),
                    }
                )

    return source.mapInArrow(
        run,
        f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, matches array<struct<label: string, first_word: bigint, end_word: bigint, edits: int>>",
    ).withColumnRenamed("id", id)
