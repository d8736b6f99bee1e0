"""Token ids in Huffman-coded files.

``encode_to_files`` tokenizes texts with the tokenizers library, counts every id over all documents, fits a
canonical length-limited Huffman code to the counts (package-merge) and writes the ids in ascending key order.
``read_files`` decodes them with one lookup table.

File format (Parquet as container, so any store Spark knows will do), one row a block:
``segment``, ``block`` and ``first_token`` (ids before it in its segment) give the order; ``keys`` int64,
``lengths`` int32 and ``words`` int32 (size of the code) hold the block's documents; ``payload`` holds each document's code bits, most significant bit
first, padded to whole big-endian 32-bit words; ``checkpoints`` uint32 holds, for each document in turn, the bit
offset (from the document's first bit) of its ids 256, 512, ... . Blocks decode on their own, and within one each
checkpoint starts a lane, so a long document decodes in parallel. ``codebook`` holds the code lengths by id.

Null texts count as empty; an empty document has the end id alone. Null keys come first; repeated keys stand
together, in the order of their ids' bytes. An empty table gives files with no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm.bpe_core import byte_chars
from tesselon.llm.common import col, record, stored, text_slices, texts_of

#: Ids between checkpoints.
LANE = 256
#: Ids after which a block ends (with the document at hand).
BLOCK_IDS = 1 << 16
#: Ids of a segment, sorted as one; there are at most MAX_SEGMENTS, which bounds what the driver holds (a number for each).
#: Beyond their product, 6.9e10 ids, segments grow: 2e8 ids or some 0.3 GB of codes for 100 TB of text, sorted with spilling.
SEGMENT_IDS, MAX_SEGMENTS = 1 << 19, 1 << 17
#: Pieces whose ids one tokenizing worker keeps; beyond that it starts anew.
CACHE_PIECES = 500_000
#: Ids decoded at a time.
DECODE_IDS = 1 << 20


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` for the counts; 0 where the count is 0. Package-merge."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no code of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    level, leaf_flags = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([weights, level[0:even:2] + level[1:even:2]])
        place = np.argsort(both, kind="stable")
        level = both[place]
        leaf_flags.append(place < n)
    take = 2 * n - 2
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        out[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


class Code:
    """A canonical code: code words by (length, id), and the table that decodes ``width`` bits at once."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = int(self.lengths.max(initial=1))
        self.words = np.zeros(len(lengths), np.uint64)
        self.table = np.zeros(1 << self.width, np.uint32)
        used = np.flatnonzero(self.lengths)
        used = used[np.argsort(self.lengths[used], kind="stable")]
        spans = np.int64(1) << (self.width - self.lengths[used])
        starts = np.cumsum(spans) - spans
        self.words[used] = (starts >> (self.width - self.lengths[used])).astype(np.uint64)
        filled = np.repeat((used << 5 | self.lengths[used]).astype(np.uint32), spans)
        self.table[: len(filled)] = filled

    def pack(self, ids: np.ndarray, doc_lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code words of documents, each from a 32-bit boundary on: the words, each document's word count, bit offsets of all ids from their document's start."""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        rel = ends - bits
        doc_ends = np.cumsum(doc_lens)
        doc_bits = np.append(0, ends)[doc_ends] - np.append(0, ends)[doc_ends - doc_lens]
        rel = rel - np.repeat(np.append(0, ends)[doc_ends - doc_lens], doc_lens)
        doc_words = (doc_bits + 31) >> 5
        base = (np.cumsum(doc_words) - doc_words) << 5
        at = rel + np.repeat(base, doc_lens)
        out = np.zeros(int(doc_words.sum()) + 2, np.uint64)
        if len(ids):
            value = self.words[ids] << (64 - (at & 31) - bits).astype(np.uint64)
            word = at >> 5
            first = np.flatnonzero(np.append(True, np.diff(word) > 0))
            where = word[first]
            out[where] += np.add.reduceat(value >> np.uint64(32), first)
            out[where + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out[:-2].astype(">u4"), doc_words, rel

    def unpack(self, words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of lanes: ``counts[i]`` ids from bit ``starts[i]`` on, lane after lane. All lanes advance together."""
        total = int(counts.sum())
        out = np.empty(total, np.uint32)
        if not total:
            return out
        words = np.append(words.astype(np.uint64), np.zeros(2, np.uint64))
        order = np.argsort(-counts, kind="stable")
        at, left = starts[order].astype(np.int64), counts[order]
        put = (np.cumsum(counts) - counts)[order]
        shift = np.int64(64 - self.width)
        mask = np.uint64((1 << self.width) - 1)
        active = np.searchsorted(-left, -np.arange(int(left[0])), side="left")  # lanes with more than k ids
        for k, n in enumerate(active.tolist()):
            p = at[:n]
            w = p >> 5
            window = words[w] << np.uint64(32) | words[w + 1]
            entry = self.table[(window >> (shift - (p & 31)).astype(np.uint64)) & mask]
            out[put[:n] + k] = entry >> np.uint32(5)
            at[:n] = p + (entry & np.uint32(31))
        return out


# ---------------------------------------------------------------- tokenizing


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: ASCII and the letters of Latin-1: here lower case and normal form act on each character alone.
_SAFE = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]+")
#: Fixed value: the pattern of the word vocabulary's pre-tokens, for such characters in lower case.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9ß-öø-ÿ]+")


class _Pieces(dict):
    """Ids of a piece of text without spaces: from its pre-tokens where these are plain, else by the library as a whole.

    A plain pre-token is a piece that has itself as its only pre-token; its ids come from the library's merge model.
    """

    def __init__(self, tokenizer, kind: str):
        self.tokenizer, self.merge, self.kind = tokenizer, tokenizer.model.tokenize, kind
        self.shown = dict(enumerate(byte_chars()))

    def merged(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.shown)
        return array(self.kind, [t.id for t in self.merge(shown)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            out = self.merged(piece) if piece.islower() else self[piece.lower()]
        elif _SAFE.fullmatch(piece) and "<|" not in piece:
            parts = _WORDS.findall(piece.lower())
            out = self.merged(piece) if parts == [piece] else b"".join(map(self.__getitem__, parts))
        else:
            out = array(self.kind, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = out
        return out


class Tokenizing:
    """Ids of texts by the tokenizers library, as little-endian integers of type ``kind``.

    For a lower-casing vocabulary whose pre-tokens never hold a space or line feed, the library's ids of a text
    are those of its pieces between these in turn, so each worker asks the library for a piece once.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.tokenizer, self.limit = _tokenizer(path), cache_pieces
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.known = _Pieces(self.tokenizer, self.kind)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        get = self.known.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


@lru_cache(maxsize=1)
def _tokenizing(path: str) -> Tokenizing:
    """One per worker process: its pieces serve all tasks that the process gets."""
    return Tokenizing(path)


def tokenized(df: DataFrame, vocabulary: str, end_id: int, key: str, text: str) -> DataFrame:
    """(key, n, ids): ids with the end id as little-endian 16-bit integers, or 32-bit ones for a large vocabulary."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizing(vocabulary)
        end = array(tokens.kind, [end_id])
        for part in text_slices(batches):
            found = [x + end.tobytes() for x in tokens(texts_of(part))]
            yield record(schema, part.column("key"), [len(x) // end.itemsize for x in found], found)

    return df.select(col(key).cast("long").alias("key"), col(text).cast("string").alias("text")).mapInArrow(run, "key long, n int, ids binary")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, flat, and each document's number of them."""
    lens = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    raw = b"".join(batch.column("ids").to_pylist())
    kind = "<u2" if len(raw) == 2 * lens.sum() else "<u4"
    return np.frombuffer(raw, kind).astype(np.int64), lens


def _slices(batches: Iterator[pa.RecordBatch], ids: str = "n", limit: int = DECODE_IDS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, at = np.cumsum(batch.column(ids).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, count) over all documents; each task sums its own ids first."""
    schema = pa.schema([("id", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in _slices(batches):
            found = np.bincount(_ids(part)[0])
            if len(found) < len(total):
                total[: len(found)] += found
            else:
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield record(schema, used, total[used])

    return tokens.select("n", "ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


# ---------------------------------------------------------------- files


def encode_to_files(df: DataFrame, path: str, vocabulary: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> str:
    """Writes the ids of every text of ``df`` under ``path`` (a folder of any store Spark knows) and returns it."""
    spark = df.sparkSession
    tokens = stored(tokenized(df, vocabulary, end_id, key, text), "ids")
    counts = id_counts(tokens).toPandas()  # a row for each id of the vocabulary at most
    freq = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    freq[counts["id"].to_numpy(np.int64)] = counts["count"].to_numpy(np.int64)
    limit = max(12, int(np.count_nonzero(freq) - 1).bit_length() + 1)
    lengths = code_lengths(freq, limit)
    spark.createDataFrame([(bytes(lengths.astype(np.uint8)),)], "lengths binary").write.parquet(f"{path}/codebook")

    parts = int(min(MAX_SEGMENTS, max(1, -(-int(freq.sum()) // SEGMENT_IDS))))
    cuts = tokens.stat.approxQuantile("key", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    cuts = np.array(cuts, np.int64)
    coded = pa.schema([("segment", pa.int32()), ("key", pa.int64()), ("n", pa.int32()), ("payload", pa.binary()), ("checkpoints", pa.binary())])
    given = spark.sparkContext.broadcast(lengths)  # a number for each id of the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(given.value)
        for part in _slices(batches):
            ids, lens = _ids(part)
            keys = part.column("key")
            words, doc_words, rel = code.pack(ids, lens)
            raw, ends = words.tobytes(), (np.cumsum(doc_words) * 4).tolist()
            place = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
            marks = rel[(place % LANE == 0) & (place > 0)].astype("<u4").tobytes()
            mark_ends = (np.cumsum((lens - 1) // LANE) * 4).tolist()
            segment = np.searchsorted(cuts, np.asarray(keys.fill_null(np.iinfo(np.int64).min)), side="left")
            yield record(coded, segment.astype(np.int32), keys, part.column("n"), [raw[a:b] for a, b in zip([0, *ends], ends)], [marks[a:b] for a, b in zip([0, *mark_ends], mark_ends)])

    rows = tokens.mapInArrow(encode, "segment int, key long, n int, payload binary, checkpoints binary")
    order = ["segment", F.col("key").asc_nulls_first(), "payload"]
    rows = rows.repartition("segment").sortWithinPartitions(*order)
    rows.mapInArrow(_blocks, _BLOCK_SQL).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


_BLOCK_SQL = "segment int, block int, first_token long, n_tokens int, keys binary, null_keys int, lengths binary, words binary, payload binary, checkpoints binary"
_BLOCK = pa.schema([("segment", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int32()), ("keys", pa.binary()), ("null_keys", pa.int32()), ("lengths", pa.binary()), ("words", pa.binary()), ("payload", pa.binary()), ("checkpoints", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coded documents in order, gathered to blocks."""
    now, block, first, held, size = None, 0, 0, [], 0

    def out() -> pa.RecordBatch:
        keys = [k for k, *_ in held]
        nulls = sum(k is None for k in keys)  # they come first
        return record(
            _BLOCK, [now], [block], [first], [size],
            [np.array([k or 0 for k in keys], "<i8").tobytes()], [nulls], [np.array([n for _, n, *_ in held], "<i4").tobytes()], [np.array([len(p) // 4 for _, _, p, _ in held], "<i4").tobytes()],
            [b"".join(p for _, _, p, _ in held)], [b"".join(c for *_, c in held)],
        )

    for batch in batches:
        for segment, key, n, payload, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (segment != now or size >= BLOCK_IDS):
                yield out()
                block, first = block + 1, first + size
                held, size = [], 0
            if segment != now:
                now, block, first = segment, 0, 0
            held.append((key, n, payload, marks))
            size += n
    if held:
        yield out()


def codebook(spark: SparkSession, path: str) -> np.ndarray:
    return np.frombuffer(spark.read.parquet(f"{path}/codebook").first()[0], np.uint8)


def read_files(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids): per document its ids as little-endian 32-bit integers, how many ids stand before it and their checksum."""
    blocks = spark.read.parquet(f"{path}/blocks")
    given = spark.sparkContext.broadcast(codebook(spark, path))
    sums = blocks.groupBy("segment").agg(F.sum("n_tokens").alias("n")).orderBy("segment").collect()  # MAX_SEGMENTS rows at most
    starts, total = {}, 0
    for r in sums:
        starts[r["segment"]] = total
        total += r["n"]
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(given.value)
        for part in _slices(batches, "n_tokens"):
            rows = part.to_pylist()
            lens = np.concatenate([np.frombuffer(r["lengths"], "<i4") for r in rows]).astype(np.int64)
            doc_words = np.concatenate([np.frombuffer(r["words"], "<i4") for r in rows]).astype(np.int64)
            marks = np.concatenate([np.frombuffer(r["checkpoints"], "<u4") for r in rows]).astype(np.int64)
            lanes = (lens - 1) // LANE + 1
            doc = np.repeat(np.arange(len(lens)), lanes)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            bit = ((np.cumsum(doc_words) - doc_words) << 5)[doc]
            bit[nth > 0] += marks
            ids = code.unpack(np.frombuffer(b"".join(r["payload"] for r in rows), ">u4"), bit, np.minimum(LANE, lens[doc] - nth * LANE))
            raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(lens) * 4).tolist()
            found = [raw[a:b] for a, b in zip([0, *ends], ends)]
            keys = [k for r in rows for k in [*[None] * r["null_keys"], *np.frombuffer(r["keys"], "<i8")[r["null_keys"] :].tolist()]]
            sizes = [len(r["lengths"]) // 4 for r in rows]
            before = np.repeat([starts[r["segment"]] + r["first_token"] for r in rows], sizes) + np.cumsum(lens) - lens
            before -= np.repeat(np.append(0, np.cumsum([r["n_tokens"] for r in rows]))[:-1], sizes)
            yield record(schema, keys, before, lens, [zlib.crc32(x) for x in found], *[found] * with_ids)

    return blocks.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids).withColumnRenamed("key", key)
