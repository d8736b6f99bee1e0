"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array; every sequence applies its lowest-rank pair at the
same time until none has a pair left, and the surviving symbols are counted (``bpe_core.MergeTable.merge``).
A piece of text between spaces or line feeds has the same tokens wherever it stands, so each worker keeps the
counts of the pieces it has seen, in a table of bounded size.

Null and empty texts count 0 tokens; repeated rows and repeated ids each give a row; an empty table gives none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tesselon.llm.bpe_core import MergeTable, merge_table
from tesselon.llm.common import col, record, text_slices, texts_of

#: Pieces whose counts one worker keeps; beyond that it starts anew.
CACHE_PIECES = 400_000
#: Fixed value: the pattern of the word vocabulary's pre-tokens.
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: Letters only, in a range where lower-casing and normal form are one to one: such a piece is one pre-token.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

SCHEMA = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def lowered(text: str) -> str:
    """Lower case character by character, without the rule for final sigma."""
    low = text.lower()
    return low if "Σ" not in text else "".join(c.lower() for c in text)


def pre_tokens(piece: str) -> list[bytes]:
    if PLAIN.fullmatch(piece):
        return [piece.lower().encode()]
    return [w.encode() for w in WORD_PATTERN.findall(lowered(unicodedata.normalize("NFC", piece)))]


class PieceCounter:
    """Counts tokens of texts for a lower-casing word vocabulary."""

    def __init__(self, table: MergeTable, cache_pieces: int = CACHE_PIECES):
        self.table, self.limit = table, cache_pieces
        self.counts: dict[str, int] = {}
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(table.added, key=len, reverse=True))) if table.added else None

    def learn(self, pieces: list[str]) -> None:
        counts = self.counts
        words: list[bytes] = []
        spans: list[int] = []
        base: list[int] = []
        for piece in pieces:
            n, parts = 0, [piece]
            if self.special is not None and "<|" in piece:
                n, parts = len(self.special.findall(piece)), self.special.split(piece)
            found = [w for part in parts for w in pre_tokens(part)]
            base.append(n)
            spans.append(len(found))
            words += found
        _, lens = self.table.merge(words)
        sums = np.append(0, np.cumsum(lens))
        ends = np.cumsum(np.array(spans, np.int64))
        totals = sums[ends] - sums[ends - np.array(spans, np.int64)] + np.array(base, np.int64)
        counts.update(zip(pieces, totals.tolist(), strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.counts) > self.limit:
            self.counts.clear()
        new = set().union(*split) - self.counts.keys()
        if new:
            self.learn(list(new))
        get = self.counts.__getitem__
        return [sum(map(get, pieces)) for pieces in split]


def count_tokens(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row of ``df``; ``vocabulary`` is a path that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PieceCounter(merge_table(vocabulary))
        for part in text_slices(batches):
            sizes = pc.binary_length(part.column("text")).fill_null(0).cast(pa.int64())
            yield record(SCHEMA, part.column("key"), sizes, count(texts_of(part)))

    out = df.select(col(key).cast("long").alias("key"), col(text).cast("string").alias("text")).mapInArrow(run, "key long, n_bytes long, n_tokens long")
    return out.withColumnRenamed("key", key)
