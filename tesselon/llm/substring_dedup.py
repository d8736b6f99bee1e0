"""Substring deduplication by relative Lempel-Ziv parsing against an index of reference blocks.

A document is cut into blocks: each window of WINDOW words belongs to its anchor, the leftmost of its ANCHOR-word
phrases with the smallest hash, and a block is what the windows of one anchor cover. Cuts depend on content alone,
so equal windows of two documents lie at the same place of blocks with equal anchors. The reference index holds,
by anchor, where each different block first stands: the first document and the place in it. The parse of a document
goes from left to right. A block of the index gives a phrase (from, to, document, place there), and the phrase grows as
long as the next block or window continues it at the next place of the same document; what can't be continued starts a
new phrase. A factor is a phrase grown as far as it goes; one of WINDOW words or more, copied from an earlier document,
is a duplicate span. Where an anchor has several different blocks, a document that holds one of them first is at a
factor boundary there: every window around it is looked up by itself among the windows of such blocks. So a window is
found exactly if it starts in an earlier document too, however often, and only the words around boundaries are indexed
one by one. Factors are greedy along the first document that holds a phrase, not over all documents that hold it: for
duplicate spans the two give the same words.

Documents whose word sequence is that of an earlier one are copies as a whole and take no part in the parse.

Null texts have no words. A document with a null id is never earlier than another and loses nothing. Rows with one
id do not remove each other's words; each gives a row. Documents under WINDOW words have no windows. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import Scratch, col, record, text_slices
from tesselon.llm.hashing import Ranges, WordHashes, mixed

WINDOW = 50
ANCHOR = 16

_BLOCK = pa.struct([("h", pa.int64()), ("ctx", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
_DOCS = pa.schema([("key", pa.int64()), ("dig", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("blocks", pa.list_(_BLOCK))])
_DOCS_SQL = "key long, dig long, n_words long, sha binary, blocks array<struct<h:long,ctx:long,lo:int,hi:int>>"


def split(part: pa.RecordBatch) -> list[list[bytes]]:
    return [(t or "").encode().split() for t in part.column("text").to_pylist()]


class Anchored:
    """The windows of many documents, flat: hash ranges, and each window's anchor."""

    def __init__(self, docs: list[list[bytes]], hashes: WordHashes, window: int = WINDOW, anchor: int = ANCHOR):
        self.window = window
        self.sizes = np.array([len(w) for w in docs], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ranges = Ranges(hashes.of([w for words in docs for w in words]))
        counts = np.maximum(0, self.sizes - window + 1)
        self.doc = np.repeat(np.arange(len(docs)), counts)
        self.place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)  # of windows, in their document
        at = self.place + self.starts[self.doc]
        width = window - anchor + 1
        grams = self.ranges.grams(anchor)
        if len(at):
            lowest = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
            self.anchor = at + lowest[at]
            self.hash = grams[self.anchor]
        else:
            self.anchor, self.hash = at, np.empty(0, np.uint64)
        self.at = at

    def blocks(self) -> tuple[np.ndarray, ...]:
        """By document and place: document, first and last window, anchor hash, hash of the content."""
        if not len(self.at):
            none = np.empty(0, np.int64)
            return none, none, none, none, none
        first = np.flatnonzero(np.append(True, (np.diff(self.anchor) != 0) | (np.diff(self.doc) != 0)))
        last = np.append(first[1:], len(self.at)) - 1
        lead = (self.anchor[first] - self.at[first]).astype(np.uint64)
        content = self.ranges(self.at[first], self.at[last] + self.window)
        content = mixed(content + lead * np.uint64(2654435761) + (last - first).astype(np.uint64))
        return self.doc[first], self.place[first], self.place[last], self.hash[first].view(np.int64), content.view(np.int64)


def parsed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dig, n_words, sha, blocks) of every row; dig tells rows with one key apart, sha is that of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in text_slices(batches):
            docs = split(part)
            found = Anchored(docs, hashes)
            doc, lo, hi, h, ctx = found.blocks()
            offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=len(docs)))).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(h), pa.array(ctx), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], fields=list(_BLOCK))
            yield record(_DOCS, part.column("key"), part.column("dig"), found.sizes, [hashlib.sha256(b" ".join(w)).digest() for w in docs], pa.ListArray.from_arrays(pa.array(offsets), flat))

    body = F.coalesce(col(text).cast("string"), F.lit(""))
    return df.select(col(key).cast("long").alias("key"), F.xxhash64(body).alias("dig"), body.alias("text")).mapInArrow(run, _DOCS_SQL)


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("key", pa.int64()), ("dig", pa.int64()), ("at", pa.int32())])
    hashes = WordHashes()
    for part in text_slices(batches):
        found = Anchored(split(part), hashes)
        first = np.searchsorted(found.doc, np.arange(part.num_rows))
        picked = [first[k] + np.arange(x["lo"], x["hi"] + 1) for k, spans in enumerate(part.column("spans").to_pylist()) for x in spans if x["open"]]
        if not picked:
            continue
        rows = np.concatenate(picked)
        start = found.at[rows]
        keys = [np.asarray(part.column(c)) for c in ("key", "dig")]
        doc = found.doc[rows]
        yield record(schema, found.hash[rows].view(np.int64), found.ranges(start, start + found.window).view(np.int64), keys[0][doc], keys[1][doc], found.place[rows].astype(np.int32))


def factors_of(pieces: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Greedy factors [first word, end, document, place there] from pieces of that form, each WINDOW words or more, in order of their first words."""
    out: list[list[int]] = []
    for lo, hi, doc, place in sorted(pieces):
        if out and lo <= out[-1][1] and doc == out[-1][2] and place - lo == out[-1][3] - out[-1][0]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi, doc, place])
    return out


_CUT_SQL = "key long, n_words long, n_removed long, sha binary, spans array<int>, factors array<struct<from:int,to:int,doc:long,place:int>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factor = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("doc", pa.int64()), ("place", pa.int32())])
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.binary()), ("spans", pa.list_(pa.int32())), ("factors", pa.list_(factor))])
    for part in text_slices(batches):
        out = []
        for words, spans, starts in zip(split(part), part.column("spans").to_pylist(), part.column("starts").to_pylist(), strict=True):
            found = [(x["lo"], x["hi"] + WINDOW, x["doc"], x["place"]) for x in spans if not x["open"]]
            found = factors_of(found + [(x["at"], x["at"] + WINDOW, x["doc"], x["place"]) for x in starts or ()])
            gone = np.zeros(len(words) + 1, np.int32)
            for lo, hi, _, _ in found:
                gone[lo] += 1
                gone[hi] -= 1
            gone = np.cumsum(gone) > 0
            edges = np.flatnonzero(np.diff(np.append(False, gone)))
            kept = [w for w, g in zip(words, gone.tolist(), strict=False) if not g]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).digest(), edges.tolist(), [dict(zip(("from", "to", "doc", "place"), x, strict=True)) for x in found]))
        yield record(schema, part.column("key"), *[list(x) for x in zip(*out, strict=True)])


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, spans, factors) of every row.

    spans: start, end, start, end ... of removed words; factors: from, to, the document they copy and the place there.
    """
    keep = Scratch(df.sparkSession)
    found = keep(parsed(df, key, text), "rlz-parsed")
    blocks = found.where("key IS NOT NULL").select("key", "dig", F.explode("blocks").alias("b")).select("b.*", "key", "dig")
    twins = keep(found.groupBy("sha").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("sha", "first"), "rlz-twins")
    docs = found.select("key", "dig", "n_words", "sha").join(twins, "sha", "left").withColumn("copy", F.coalesce(F.col("key") > F.col("first"), F.lit(False)))
    docs = keep(docs, "rlz-docs")
    copies = docs.where("copy").select("key", "dig").distinct()
    shared = keep(blocks.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a < z").select("h"), "rlz-anchors")
    held = keep(blocks.join(shared, "h"), "rlz-blocks")
    keep.drop("rlz-parsed", "rlz-twins", "rlz-anchors")
    firsts = keep(held.groupBy("h", "ctx").agg(F.min(F.struct("key", "lo")).alias("first")), "rlz-firsts")
    several = keep(firsts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(True).alias("several")), "rlz-several")
    index = keep(firsts.join(several, "h", "left").select("h", "ctx", F.col("first.key").alias("doc"), F.col("first.lo").alias("place"), "several"), "rlz-index")
    factors = held.join(index, ["h", "ctx"]).where("key > doc OR several").select("key", "dig", F.struct("lo", "hi", (F.col("key") == F.col("doc")).alias("open"), "doc", "place").alias("span"))
    factors = factors.join(copies, ["key", "dig"], "left_anti").groupBy("key", "dig").agg(F.collect_list("span").alias("spans"))  # as many as a document has blocks at most
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    texts = df.select(col(key).cast("long").alias("key"), F.xxhash64(body).alias("dig"), body.alias("text"))
    touched = keep(texts.join(factors, ["key", "dig"]), "rlz-touched")
    keep.drop("rlz-blocks", "rlz-firsts", "rlz-several", "rlz-index")
    windows = keep(touched.where(F.exists("spans", lambda x: x["open"])).select("key", "dig", "text", "spans").mapInArrow(_open_windows, "h long, w long, key long, dig long, at int"), "rlz-windows")
    first = keep(windows.groupBy("h", "w").agg(F.min(F.struct("key", "at")).alias("a"), F.max("key").alias("z")).where("a.key < z").select("h", "w", F.col("a.key").alias("doc"), F.col("a.at").alias("place")), "rlz-first")
    starts = windows.join(first, ["h", "w"]).where("key > doc").groupBy("key", "dig").agg(F.collect_set(F.struct("at", "doc", "place")).alias("starts"))
    cut = touched.join(starts, ["key", "dig"], "left").select("key", "text", "spans", "starts").mapInArrow(_cut, _CUT_SQL)
    whole = F.col("copy") & (F.col("n_words") >= WINDOW)
    nothing = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    rest = docs.join(touched.select("key", "dig").distinct(), ["key", "dig"], "left_anti").select(
        "key",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(whole, nothing).otherwise(F.col("sha")).alias("sha"),
        F.when(whole, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.array().cast("array<int>")).alias("spans"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to"), F.col("first").alias("doc"), F.lit(0).alias("place")))).otherwise(F.array()).cast("array<struct<from:int,to:int,doc:long,place:int>>").alias("factors"),
    )
    return cut.unionByName(rest).select(F.col("key").alias(key), "n_words", "n_removed", F.lower(F.hex("sha")).alias("kept_sha256"), "spans", "factors")
