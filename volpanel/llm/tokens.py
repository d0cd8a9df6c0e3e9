"""Token ids of many texts at once, equal to those of a byte-level BPE file of the ``tokenizers`` library.

A byte-level BPE cuts a text into short pieces (letters, digits, other marks, white space) and encodes every piece by
itself, so equal pieces have equal ids. The pieces of a block are found on its code points with numpy, hashed, and
only pieces not seen before go through the merges (by ``tiktoken``, with the ranks of the same file). Texts with characters outside the ranges where all
Unicode versions agree on the classes, or with the text of a special token, are encoded whole by the tokenizer.
"""

from __future__ import annotations

import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa

from volpanel.llm.words import CHUNK, mix, powers, ragged

LETTER, DIGIT, SPACE, OTHER, RARE = range(5)
STABLE = 0x0530
KNOWN_MARKS = range(0x2010, 0x2028)
BASE = 0xC2B2AE3D27D4EB4F
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEEP = 1 << 18


def class_table() -> np.ndarray:
    out = np.full(0x110000, RARE, np.uint8)
    for c in [*range(STABLE), *KNOWN_MARKS]:
        kind = unicodedata.category(chr(c))
        if kind == "Cn" or 0x1C <= c <= 0x1F:
            continue
        white = kind in ("Zs", "Zl", "Zp") or 9 <= c <= 13 or c == 0x85
        out[c] = LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else SPACE if white else OTHER
    return out


def ranks_of(tokenizer) -> dict[bytes, int]:
    """The vocabulary as bytes; a byte-level file writes every byte as a printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(byte[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in byte for c in token)}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; it stays for the tasks that follow."""
    kept = sys.modules.setdefault("_volpanel_encoders", types.ModuleType("_volpanel_encoders"))
    if not hasattr(kept, "by_path"):
        kept.by_path = {}
    if path not in kept.by_path:
        kept.by_path[path] = Encoder(path)
    return kept.by_path[path]


class Encoder:
    """Ids of texts; keeps the ids of at most ``keep`` pieces."""

    def __init__(self, path: str, keep: int = KEEP):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {k: v for k, v in ranks_of(self.tokenizer).items() if k.decode(errors="replace") not in special}
        self.merges = tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = class_table()
        rng = np.random.default_rng(7)
        self.weight = rng.integers(1, 2**63, 0x110000, dtype=np.uint64)
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def cut(self, points: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First code point of every piece."""
        n = len(points)
        first = np.ones(n, bool)
        first[1:] = kind[1:] != kind[:-1]
        begins = offsets[:-1][offsets[:-1] < n]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first[begins] = True
        # the last of a run of white space stands alone, or joins the next piece if it is a blank
        space = kind == SPACE
        after = np.ones(n, bool)  # the run ends here and its text goes on
        after[:-1] = ~space[1:]
        last = space & after & ~edge[1:]
        where = np.flatnonzero(last)
        first[where] = True
        blank = where[points[where] == 32]
        joined = blank + 1
        first[joined] = False
        # 's 't 're 've 'm 'll 'd when the apostrophe begins a piece and is all of it
        quote = np.flatnonzero((points == 39) & first)
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == LETTER) & first[quote + 1] & ~edge[quote + 1]]
        for q in quote.tolist():
            tail = "".join(map(chr, points[q + 1 : q + 3].tolist())) if not edge[q + 2] else chr(points[q + 1])
            size = next((len(c) for c in CONTRACTIONS if tail.startswith(c)), 0)
            if size:
                first[q + 1] = False
                if q + 1 + size < n:
                    first[q + 1 + size] = True
        return np.flatnonzero(first)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text begins."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        kind = self.classes[points]
        odd = np.concatenate([[0], np.cumsum(kind == RARE)])
        odd = odd[offsets[1:]] > odd[offsets[:-1]]
        for k, text in enumerate(texts):
            odd[k] = odd[k] or any(s in text for s in self.special)
        if odd.any():
            plain_ids, plain_at = self.encode_plain([t for t, o in zip(texts, odd) if not o])
            whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([t for t, o in zip(texts, odd) if o], add_special_tokens=False)]
            out, i, j = [], 0, 0
            for o in odd:
                if o:
                    out.append(whole[j])
                    j += 1
                else:
                    out.append(plain_ids[plain_at[i] : plain_at[i + 1]])
                    i += 1
            return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])
        return self._encode(points, kind, offsets)

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._encode(points, self.classes[points], np.concatenate([[0], np.cumsum(sizes)]))

    def _encode(self, points: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(points)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = self.cut(points, kind, offsets)
        ends = np.append(starts[1:], n)
        hashes = self.hash(points, starts, ends)
        spot = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        missing = self.hashes[spot] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if missing.any():
            self.learn(points, starts[missing], ends[missing], hashes[missing])
            spot = np.searchsorted(self.hashes, hashes)
            if (self.hashes[np.minimum(spot, len(self.hashes) - 1)] != hashes).any():  # the table was cleared
                self.learn(points, starts, ends, hashes)
                spot = np.searchsorted(self.hashes, hashes)
        count = self.at[spot + 1] - self.at[spot]
        ids = self.flat[ragged(self.at[spot], count)]
        before = np.concatenate([[0], np.cumsum(count)])
        return ids, before[np.searchsorted(starts, offsets)]

    def hash(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        longest = int((ends - starts).max())
        up = powers(BASE, longest + CHUNK)
        down = powers(pow(BASE, -1, 1 << 64), longest + CHUNK)
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
            a, b = starts[i], ends[j - 1]
            out[i:j] = np.add.reduceat(self.weight[points[a:b]] * up[: b - a], starts[i:j] - a) * down[starts[i:j] - a]
            i = j
        return mix(out ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))

    def learn(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        new, which = np.unique(hashes, return_index=True)
        if len(self.hashes) + len(new) > self.keep:
            self.clear()
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
        encode = self.merges.encode_ordinary
        ids = pa.array([encode(text[a:b]) for a, b in zip(starts[which].tolist(), ends[which].tolist())], pa.list_(pa.uint32()))
        sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        flat = ids.values.to_numpy()
        old = np.diff(self.at)
        every = np.concatenate([self.hashes, new])
        order = np.argsort(every)
        count = np.concatenate([old, sizes])
        begin = np.cumsum(count) - count
        pool = np.concatenate([self.flat, flat])
        self.flat = pool[ragged(begin[order], count[order])]
        self.hashes = every[order]
        self.at = np.concatenate([[0], np.cumsum(count[order])])
