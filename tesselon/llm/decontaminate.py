"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents. Its words become the ids of the test items' words, all others a separator; runs
too short to hold a test phrase go too (they can't match). Over what stays stands an FM-index: suffixes are sorted
by prefix doubling, ranks in the Burrows-Wheeler transform come from a wavelet matrix, all test phrases are searched
backwards at once, occurrences are located by walking to sampled suffix positions, and the spans merged.

The test items are a stated query set, cut into blocks of bounded size. Each block is one more pass over the same rows;
between passes what was found is stored, and driver and executors hold one block at a time (and the driver the next).

Null texts have no words; items without words match nothing; equal items all count; repeated documents each give a
row; empty tables give no rows or rows without hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import Scratch, col, free_name, text_slices

#: Words of a phrase.
WINDOW = 8
#: Bytes of test texts searched for in one pass.
BLOCK_BYTES = 8 << 20
#: Every so many suffix positions one is kept.
SAMPLE = 8

_MARK = b"\xff"  # no UTF-8 text has this byte
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


class Phrases:
    """The phrases of a block of items as rows of word ids, and each phrase's items."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + WINDOW]), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.lens = np.array([len(p) for p in found], np.int64)
        self.rows = np.zeros((len(found), WINDOW), np.int64)
        for k, p in enumerate(found):
            self.rows[k, : len(p)] = p
        self.shortest = int(self.lens.min(initial=WINDOW))
        self.lookup = {**self.vocab, _MARK: -1}


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling; symbols that never repeat end a comparison."""
    _, rank = np.unique(symbols, return_inverse=True)
    rank, step, n = rank.astype(np.int64), 1, len(symbols)
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1 if step < n else 0
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(0, np.diff(key[order]) > 0))
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """rank(symbol, position) of a sequence, for many queries at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, int(top).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.append(0, np.cumsum(bit))
            self.levels.append((ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How many of the first ``position`` values equal ``symbol``."""
        low, high = np.zeros_like(position), position
        for level, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> level) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """Over word ids with 0 as separator (also at the end)."""

    def __init__(self, ids: np.ndarray, top: int):
        seps = ids == 0
        single = np.where(seps, np.cumsum(seps) - 1, ids + seps.sum())  # separators differ from each other
        order = suffix_order(single)
        before = ids[order - 1]
        self.before = before
        self.tree = WaveletMatrix(before, top)
        self.first = np.append(0, np.cumsum(np.bincount(ids, minlength=top + 1)))
        kept = (order % SAMPLE == 0) | (before == 0)  # a walk never crosses a separator
        self.kept = kept
        self.kept_at = np.cumsum(kept) - 1
        self.samples = order[kept]

    def search(self, rows: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase the range of suffixes that it starts."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.before), np.int64)
        for back in range(1, int(lens.max(initial=0)) + 1):
            on = np.flatnonzero((lens >= back) & (low < high))
            c = rows[on, lens[on] - back]
            low[on] = self.first[c] + self.tree.rank(c, low[on])
            high[on] = self.first[c] + self.tree.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        at, steps, out = suffixes.copy(), np.zeros(len(suffixes), np.int64), np.empty(len(suffixes), np.int64)
        left = np.arange(len(suffixes))
        while len(left):
            here = self.kept[at[left]]
            got = left[here]
            out[got] = self.samples[self.kept_at[at[got]]] + steps[got]
            left = left[~here]
            c = self.before[at[left]]
            at[left] = self.first[c] + self.tree.rank(c, at[left])
            steps[left] += 1
        return out


def find(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Word counts of the texts, and (text, first word, end word, phrase) of all occurrences."""
    joined = (b" " + _MARK + b" ").join(texts).translate(_WORD_BYTES).split()
    ids = np.fromiter(map(phrases.lookup.get, joined, repeat(0)), np.int64, len(joined))
    ends = np.append(np.flatnonzero(ids == -1), len(ids))
    counts = np.diff(np.append(-1, ends)) - 1
    if not len(phrases.lens):
        return counts, []
    known = np.concatenate([[False], ids > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    start, stop = edges[::2], edges[1::2]
    long = stop - start >= phrases.shortest
    start, size = start[long], (stop - start)[long]
    if not len(start):
        return counts, []
    to = np.cumsum(size + 1) - (size + 1)
    place = np.full(int((size + 1).sum()), -1)
    place[np.repeat(to, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    index = FMIndex(np.where(place >= 0, ids[place], 0), len(phrases.vocab))
    low, high = index.search(phrases.rows, phrases.lens)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    at = place[index.locate(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n))]
    doc = np.searchsorted(ends, at)
    at = at - np.append(0, ends + 1)[doc]
    return counts, list(zip(doc.tolist(), at.tolist(), (at + phrases.lens[which]).tolist(), which.tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, key: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about ``limit`` bytes, one at a time on the driver."""
    block, size = [], 0
    for row in benchmark.select(col(key).cast("string"), col(text)).toLocalIterator():
        block.append((row[0] if row[0] is not None else "", row[1]))
        size += len(row[1] or "") * 2
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


_HITS = "n_words long, spans array<int>, items array<string>"


def matches(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", hits: str = "hits") -> DataFrame:
    """``df`` with the struct ``hits``, by that or the given name: n_words, spans (start, end, start, end ... in words, merged), items (ids, sorted as strings)."""
    spark = df.sparkSession
    out = df.withColumn(hits, F.lit(None).cast(f"struct<{_HITS.replace(' ', ':').replace(',:', ',')}>"))
    keep, blocks = Scratch(spark), blocks_of(benchmark, item_key, item_text)
    block, n = next(blocks, []), 0
    while True:
        given, after = spark.sparkContext.broadcast(block), next(blocks, None)
        out = _one_pass(out, given, text, hits)
        if after is None:
            return out
        out = keep(out, f"hits-{n}")  # so that the next block takes this one's place on driver and executors
        given.unpersist(blocking=False)
        keep.drop(f"hits-{n - 1}")
        block, n = after, n + 1


def _one_pass(df: DataFrame, given, text: str, hits: str) -> DataFrame:
    schema = df.schema
    struct = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(given.value)
        for part in text_slices(batches, text):
            counts, found = find([(t or "").encode() for t in part.column(text).to_pylist()], phrases)
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for doc, a, b, phrase in found:
                spans.setdefault(doc, []).append((a, b))
                items.setdefault(doc, set()).update(phrases.items[phrase])
            rows = []
            for k, (n, old) in enumerate(zip(counts.tolist(), part.column(hits).to_pylist(), strict=True)):
                mine = spans.get(k, []) + (list(zip(old["spans"][::2], old["spans"][1::2], strict=True)) if old else [])
                names = items.get(k, set()) | set(old["items"] if old else ())
                rows.append({"n_words": n, "spans": [x for span in merged(mine) for x in span], "items": sorted(names)})
            columns = [pa.array(rows, struct) if name == hits else part.column(name) for name in part.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return df.mapInArrow(run, schema)


def report(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    hits = F.col("hits")
    found = matches(df.select(col(key).alias(key), col(text).cast("string").alias(text)), benchmark, text)
    return found.select(
        key,
        hits["n_words"].alias("n_words"),
        F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda acc, x: x - acc).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        (F.size(hits["items"]) >= 2).alias("contaminated"),
    )


def cleaned(df: DataFrame, benchmark: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """``df`` without contaminated rows (two test items or more) and, in the others, without the words of test phrases; ``chars`` follows the text."""
    hits = free_name(df, "hits")
    found = matches(df.withColumn(text, col(text).cast("string")), benchmark, text, hits=hits)
    found = found.where(F.size(col(hits)["items"]) < 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            sizes = batch.column(chars).to_pylist() if chars else []
            for k, x in enumerate(batch.column(hits).to_pylist()):
                if x["spans"]:
                    texts[k] = without_spans(texts[k], x["spans"])
                    if chars:
                        sizes[k] = len(texts[k])
            new = {text: texts} | ({chars: sizes} if chars else {})
            names = [n for n in batch.schema.names if n != hits]
            yield pa.RecordBatch.from_arrays([pa.array(new[n], batch.schema.field(n).type) if n in new else batch.column(n) for n in names], names=names)

    return found.mapInArrow(run, found.drop(hits).schema)


def without_spans(text: str, spans: list[int]) -> str:
    """The text without the given word spans, from each span's first word to its last word's end."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_WORD_BYTES))]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
