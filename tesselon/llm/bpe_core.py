"""Byte-pair merging over flat numpy arrays, shared by the encoder and the token counter.

A vocabulary file in the tokenizers library's JSON form gives the merges. Symbols of many words lie in one
flat array; in every round each word applies its pair of lowest rank, found by binary search over sorted pair
keys, at all its places that do not overlap (left ones first). In these files each merge makes a token of its
own, so a pair's rank exceeds the ranks of the merges that made its parts, and a round equals the one-at-a-time
order of the reference algorithm; ``MergeTable`` refuses a file of another kind.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

NEVER = np.int64(1 << 40)


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class MergeTable:
    """Sorted pair keys with ranks and results, and the symbols of single bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.width = np.int64(max([*self.vocab.values(), *self.added.values()]) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        if len(np.unique(self.made)) != len(self.made):
            raise ValueError("two merges of this vocabulary make one token")
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        chars = byte_chars()
        self.inner = np.array([self.vocab[c] for c in chars], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in chars], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Start symbols of non-empty words, flat, and the words' lengths."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        if self.suffix and len(words):
            ends = np.cumsum(lens) - 1
            sym[ends] = self.last[raw[ends]]
        return sym, lens

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, flat, and the number of each word's ids."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sym, lens = self.symbols(words)
        n = len(lens)
        seq = np.arange(n)
        last = np.zeros(len(sym), bool)
        last[np.cumsum(lens) - 1] = True
        rank = np.append(self.rank(sym[:-1], sym[1:]), NEVER)
        rank[last] = NEVER
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(seq):
            low = np.minimum.reduceat(rank, np.cumsum(lens) - lens)
            live = low < NEVER
            if not live.all():
                stay = np.repeat(live, lens)
                done.append((seq[~live], sym[~stay], lens[~live]))
                sym, rank, last = sym[stay], rank[stay], last[stay]
                seq, lens, low = seq[live], lens[live], low[live]
                if not len(seq):
                    break
            at = np.flatnonzero(rank == np.repeat(low, lens))
            if len(at) > 1:  # of overlapping places every second one, from the left
                k = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.append(True, np.diff(at) != 1), k, 0))
                at = at[(k - first) % 2 == 0]
            sym[at] = self.made[rank[at]]
            last[at] |= last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            lens = np.add.reduceat(keep, np.cumsum(lens) - lens, dtype=np.int64)
            at = (np.cumsum(keep) - 1)[at]
            sym, rank, last = sym[keep], rank[keep], last[keep]
            for fix in (at, at[at > 0] - 1):
                after = np.minimum(fix + 1, len(sym) - 1)
                rank[fix] = np.where(last[fix], NEVER, self.rank(sym[fix], sym[after]))
        out_lens = np.empty(n, np.int64)
        for s, _, ln in done:
            out_lens[s] = ln
        starts = np.cumsum(out_lens) - out_lens
        out = np.empty(int(out_lens.sum()), np.int64)
        for s, values, ln in done:
            out[np.repeat(starts[s] - (np.cumsum(ln) - ln), ln) + np.arange(len(values))] = values
        return out, out_lens


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    """One table per worker process and file."""
    return MergeTable(path)
