"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Texts are cut into pre-tokens; the pre-tokens of a batch that a worker has not seen are merged together in one
flat symbol array, lowest-rank pairs found by binary search over sorted pair keys (``bpe_core``). Decoding joins
the ids' byte strings and reads them as UTF-8, with U+FFFD for what is not.

Null texts count as empty: no ids, empty decoded text. Repeated rows each give a row; an empty table gives none.
Strings of special tokens inside a text become their ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tesselon.llm.bpe_core import MergeTable, byte_chars, merge_table
from tesselon.llm.common import col, record, text_slices, texts_of

#: Pre-tokens whose ids one worker keeps; beyond that it starts anew.
CACHE_WORDS = 200_000
#: Fixed value: the pattern of byte-level pre-tokens.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

DIGESTS = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Codec:
    """Encodes texts to ids and decodes ids, for one byte-level vocabulary."""

    def __init__(self, table: MergeTable, cache_words: int = CACHE_WORDS):
        self.table, self.limit = table, cache_words
        self.known: dict[str, bytes] = {}
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(table.added, key=len, reverse=True)) + ")") if table.added else None
        to_byte = {c: b for b, c in enumerate(byte_chars())}
        self.bytes_of: list[bytes] = [b""] * int(table.width)
        for token, i in [*table.vocab.items(), *table.added.items()]:
            known = all(c in to_byte for c in token)
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if known else token.encode()
        self.digits = [str(i) for i in range(int(table.width))]

    def learn(self, words: list[str]) -> None:
        ids, lens = self.table.merge([w.encode() for w in words])
        raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(lens) * 4).tolist()
        self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *ends], ends)), strict=False))

    def pre_tokens(self, text: str) -> tuple[list[str], bool]:
        """Pre-tokens, with strings of special tokens among them as they are; whether there are any of these."""
        if self.special is None or not any(x in text for x in self.table.added):
            return BYTE_PATTERN.findall(text), False
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else BYTE_PATTERN.findall(part)
        return out, True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.limit:
            self.known.clear()
        split = [self.pre_tokens(t) for t in texts]
        new = set().union(*(words for words, _ in split)) - self.known.keys() - self.table.added.keys()
        if new:
            self.learn(list(new))
        for token, i in self.table.added.items():
            self.known[token] = np.array([i], "<u4").tobytes()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words, _ in split]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row."""
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(merge_table(vocabulary))
        for part in text_slices(batches):
            found = codec.encode(texts_of(part))
            offsets = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
            flat = pa.array(np.concatenate(found).astype(np.int32))
            yield record(schema, part.column("key"), pa.ListArray.from_arrays(pa.array(offsets), flat))

    return df.select(col(key).cast("long").alias("key"), col(text).cast("string").alias("text")).mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from (key, ids array<int>); null ids count as none."""
    schema = pa.schema([("key", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(merge_table(vocabulary))
        for batch in batches:
            yield record(schema, batch.column("key"), [codec.decode(x or []) for x in batch.column("ids").to_pylist()])

    return df.select(col(key).cast("long").alias("key"), col(ids).alias("ids")).mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, both as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(merge_table(vocabulary))
        sha, digits = hashlib.sha256, codec.digits.__getitem__
        for part in text_slices(batches):
            ids = [x.tolist() for x in codec.encode(texts_of(part))]
            yield record(
                DIGESTS,
                part.column("key"),
                [len(x) for x in ids],
                [sha(",".join(map(digits, x)).encode()).hexdigest() for x in ids],
                [sha(codec.decode(x).encode()).hexdigest() for x in ids],
            )

    out = df.select(col(key).cast("long").alias("key"), col(text).cast("string").alias("text")).mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
