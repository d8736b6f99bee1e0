"""N-gram Jaccard join: exact links between sets of word shingles, as components.

Equal sets form one class, and only classes are compared. A set's shingles have an order, rare ones first, and its
index entries are the first ones of it: so many that linked sets share one. How rare a shingle is comes from two count
sketches of fixed size over all documents, one of shingles and one of words; where the former is too full to tell
rare ones apart, the latter does. An order that is wrong costs time and loses no link.

Skipping by position: an entry at place p of a set of n shingles can be the first common one of sets with at most
``reach`` = (n - p) (1 + t) / t - n shingles. So a list falls into blocks: entries that reach their own size, which
alone can be the smaller one of a pair, and the others, which only look for smaller sets. A list without the former
is skipped, so is an entry of the latter that does not reach the list's smallest set, and so is any pair of which one
does not reach the other.

Skipping by answers: first each list's smallest set is compared with the others of the list. From then on sets of one
component need no comparison with each other, so a list whose sets are all of one component is closed. In an open one,
sets outside its largest component lead: about LEADERS of them (twice as many in each further round), drawn by a hash of
the id and so the same in many lists, are compared with the list's sets of other components: first with about PROBES of
them, which links most that link any; leaders that are then still outside the largest component meet all others and
leave the list. Their
answers derive from what the first round computed for the list's smallest set L: which shingles of L a set lacks, as a
bitmap, and which others it has, hashed to EXTRA_BITS bits. X and Y have |L| - |lacked by X or Y| of L's shingles in common,
exactly, and at most as many others as bits in common and collisions tell; pairs for which the sum is too small are
skipped, as nearly all pairs of sets that differ from L in places of their own are. Rounds end when no list is open,
after as many as doubling takes to reach the longest list's number of sets outside its largest component, at most.

Nothing is gathered by list but counts; pairs of a list are made with its leaders alone. Lists of frequent shingles
arise only from sets that have no rarer ones, such as copies, which are of one component after the first round.

Null texts and texts without words have the empty set and link with nothing. A null id has no component. Rows with
one id and different texts: the links of each are the id's, except where the text is that of a smaller id; then the row
has that one's component. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import Scratch, col, free_name, record, text_slices
from tesselon.llm.components import components
from tesselon.llm.hashing import Ranges, WordHashes, mixed

SIZE = 4
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 85
#: Sets of a list that lead it in the second round.
LEADERS = 16
#: Sets of a list that its leaders meet before they meet all.
PROBES = 16
#: Counters of the sketches of shingles and of words, as powers of two, and those of one row of a sketch.
SHINGLE_BITS, WORD_BITS, CHUNK_BITS = 22, 20, 16
#: Bits that stand for the shingles of a set that a list's smallest set lacks.
EXTRA_BITS = 1024
#: Ids or lists that are sent to all executors at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Leaders, with what is known of them (some 350 bytes each, more for long texts), that are.
BROADCAST_LEADERS = 40_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SETS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def needed(n: int, percent: int) -> int:
    """Least common shingles of a set of ``n`` with any set it links."""
    return (percent * n + 99) // 100


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


class Shingler:
    """Shingle sets of texts: sorted hashes, and the place of each in the order of entries."""

    def __init__(self, size: int, sketches: tuple[np.ndarray, np.ndarray] | None = None):
        self.size, self.sketches = size, sketches
        self.hashes = WordHashes()

    def flat(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, Ranges]:
        """Word counts of the texts, hashes of all words, and of their ranges."""
        docs = [words_of(t) for t in texts]
        h = self.hashes.of([w for words in docs for w in words])
        return [len(words) for words in docs], h, Ranges(h)

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes, h, ranges = self.flat(texts)
        place = grams = ranges.grams(self.size)
        if self.sketches is not None and len(grams):
            seen, words = self.sketches
            weight = words[(h >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
            score = sum(weight[k : k + len(grams)].astype(np.uint64) for k in range(self.size))
            place = seen[(grams >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | score << np.uint64(32) | (grams & np.uint64(0xFFFFFFFF))
        out, end = [], 0
        for n in sizes:
            end += n
            if n >= self.size:
                items, first = np.unique(grams[end - n : end - self.size + 1], return_index=True)
                out.append((items, place[end - n + first]))
            elif n:
                item = mixed(ranges(np.array([end - n]), np.array([end])) + np.uint64(n))
                out.append((item, item))
            else:
                out.append((grams[:0], grams[:0]))
        return out


def packed(counts: np.ndarray) -> bytes:
    """Counters compressed, byte by byte of their size: most have only the lowest one."""
    return zlib.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def sketched(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of shingles and of words by the top bits of their hashes: growing with their number in all texts.

    A task sends its counters compressed; the merged ones are of fixed size, whatever the table's.
    """
    shingles, words = 1 << SHINGLE_BITS, 1 << WORD_BITS
    chunk = 1 << CHUNK_BITS
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(size)
        counts = np.zeros(shingles + words, np.int64)
        for part in text_slices(batches):
            _, h, ranges = make.flat(part.column("text").to_pylist())
            for values, bits, shift in ((ranges.grams(size), SHINGLE_BITS, 0), (h, WORD_BITS, shingles)):
                np.add.at(counts, (values >> np.uint64(64 - bits)).astype(np.int64) + shift, 1)
        for k in range(0, len(counts), chunk):
            if (part := counts[k : k + chunk]).any():
                yield record(schema, [k // chunk], [packed(part)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + unpacked(raw)
        for k, counts in sums.items():
            yield record(schema, [k], [packed(counts)])

    counts = np.zeros(shingles + words, np.int64)
    found = texts.select("text").mapInArrow(run, "chunk int, counts binary").repartition("chunk").mapInArrow(merge, "chunk int, counts binary")
    for row in found.collect():  # (shingles + words) / chunk rows
        counts[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = unpacked(row["counts"])
    load = int(counts[:shingles].mean())  # what a counter holds besides the shingle asked for
    seen = np.round(8 * np.log2(np.maximum(counts[:shingles] - load, 0) + 1)).astype(np.uint16)
    return seen, np.round(64 * np.log2(counts[shingles:] + 1)).astype(np.uint16)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(col(key).cast("long").alias("key"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))


def sets_of(texts: DataFrame, size: int, percent: int, sketches) -> DataFrame:
    """(key, n, sig, prefix) of every row; equal sets have equal sigs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(size, sketches.value)
        for part in text_slices(batches):
            sets = make(part.column("text").to_pylist())
            heads = [s[np.argsort(place)[: len(s) - needed(len(s), percent) + 1]] if len(s) else s for s, place in sets]
            offsets = np.append(0, np.cumsum([len(h) for h in heads])).astype(np.int32)
            flat = np.concatenate(heads).view(np.int64)
            yield record(_SETS, part.column("key"), [len(s) for s, _ in sets], [hashlib.md5(s.tobytes()).digest() for s, _ in sets], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))

    return texts.mapInArrow(run, "key long, n long, sig binary, prefix array<long>")


def bitmap(at: np.ndarray, size: int) -> np.ndarray:
    """64-bit words in which the given bits are set."""
    out = np.zeros(-(-size // 64) * 64, np.uint8)
    out[at] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


_COMPARED = "a long, b long, na long, nb long, common long, lacked array<long>, extra array<long>"


def _comparing(size: int, derive: bool):
    """Counts the common shingles of pairs of texts, and with ``derive`` tells what b lacks of a's and has besides; rows come by ``a``."""
    words = pa.list_(pa.int64())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("common", pa.int64()), ("lacked", words), ("extra", words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(size)
        lead: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for part in text_slices(batches, limit=1 << 20):
            out = []
            for (x, _), text in zip(make(part.column("text").to_pylist()), part.column("lead_text").to_pylist(), strict=True):
                if text != lead[0]:
                    lead = (text, make([text])[0][0])
                mine = np.isin(x, lead[1], assume_unique=True)
                lacked = extra = None
                if derive:
                    lacked = bitmap(np.flatnonzero(np.isin(lead[1], x, assume_unique=True, invert=True)), len(lead[1]))
                    extra = bitmap((x[~mine] % np.uint64(EXTRA_BITS)).astype(np.int64), EXTRA_BITS)
                out.append((len(lead[1]), len(x), int(mine.sum()), lacked, extra))
            yield record(schema, part.column("a"), part.column("b"), *[list(c) for c in zip(*out, strict=True)])

    return run


def _ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, x: acc + F.bit_count(x))


def _fits(na: Column, reach_a: Column, nb: Column, reach_b: Column, percent: int) -> Column:
    """Whether two entries of a list can be the first common one of linked sets."""
    return (nb <= reach_a) & (na <= reach_b) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


#: What the first round tells of a set and its list's smallest one: that one's size, what it lacks and what it has besides.
KNOWN = ("na", "lacked", "extra")


class Join:
    """One run of the join: entries, lists, comparisons and labels."""

    def __init__(self, texts: DataFrame, size: int, percent: int):
        self.texts, self.size, self.percent = texts, size, percent
        self.keep = Scratch(texts.sparkSession)

    def held(self, sets: DataFrame) -> DataFrame:
        """(s, key, n, reach) of the entries that other sets may meet, from the sets' entries."""
        lists = sets.select(F.posexplode("prefix").alias("p", "s"), "key", "n")
        lists = lists.select("s", "key", "n", F.expr(f"(n - p) * {100 + self.percent} div {self.percent} - n").alias("reach"))
        smaller = F.col("reach") >= F.col("n")
        shared = lists.groupBy("s").agg(F.count("*").alias("rows"), F.min(F.when(smaller, F.col("n"))).alias("least")).where("rows > 1 AND least IS NOT NULL")
        shared = self.keep(shared.select("s", "least"), "set-shared")
        found = self.keep(lists.join(shared, "s").where("reach >= least").select("s", "key", "n", "reach"), "set-held")
        self.keep.drop("set-shared")
        return found

    def led(self, held: DataFrame) -> DataFrame:
        """``held`` with the list's lead, its smallest set, whether the entry fits it, and the list's rows; lists without a chance go."""
        leads = held.where("reach >= n").groupBy("s").agg(F.min(F.struct("n", "key", "reach")).alias("lead"))
        rows = held.groupBy("s").agg(F.count("*").alias("rows")).where("rows > 1")
        lead = F.col("lead")
        fits = (F.col("key") != lead["key"]) & _fits(lead["n"], lead["reach"], F.col("n"), F.col("reach"), self.percent)
        out = held.join(leads.join(rows, "s"), "s").withColumn("fits", fits)
        return self.keep(out.where((F.col("rows") > 2) | fits).where(F.col("key") != lead["key"]).select("s", "key", "n", "reach", lead["key"].alias("lead"), "fits", "rows"), "set-led")

    def near(self, keys: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
        """``keys``, sent to all executors where their number is bounded."""
        return F.broadcast(keys) if keys.count() <= most else keys

    def nodes(self, led: DataFrame) -> DataFrame:
        keys = self.keep(led.select("key").union(led.select("lead")).distinct(), "set-keys")
        return self.keep(self.texts.join(self.near(keys), "key", "left_semi"), "set-texts")

    def compared(self, pairs: DataFrame, nodes: DataFrame, derive: bool = False) -> DataFrame:
        """(a, b, na, nb, common, lacked, extra, linked) of pairs (a, b)."""
        pairs = self.keep(pairs, "set-pairs")
        lead = nodes.join(self.near(self.keep(pairs.select(F.col("a").alias("key")).distinct(), "set-leads")), "key").select(F.col("key").alias("a"), F.col("text").alias("lead_text"))
        both = nodes.withColumnRenamed("key", "b").join(self.near(pairs), "b").join(lead, "a")
        out = both.select("a", "b", "text", "lead_text").sortWithinPartitions("a").mapInArrow(_comparing(self.size, derive), _COMPARED)
        return self.keep(out.withColumn("linked", 100 * F.col("common") >= self.percent * (F.col("na") + F.col("nb") - F.col("common"))), "set-compared")

    def labels(self, compared: DataFrame, round_: int) -> DataFrame:
        return components(compared.where("linked").select("a", "b"), self.keep, f"set-labels-{round_}")

    def open_lists(self, held: DataFrame, labels: DataFrame) -> DataFrame:
        """``held`` with comp, the list's largest component (most) and its number of other sets (others), of lists with several components."""
        mine = held.join(labels.select(F.col("node").alias("key"), "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        by = mine.groupBy("s", "comp").agg(F.count("*").alias("rows"))
        lists = by.groupBy("s").agg(F.max(F.struct("rows", "comp")).alias("most"), F.sum("rows").alias("all"), F.count("*").alias("comps")).where("comps > 1")
        lists = self.keep(lists.select("s", F.col("most.comp").alias("most"), (F.col("all") - F.col("most.rows")).alias("others"), F.col("all").alias("rows")), "set-open-lists")
        return self.keep(mine.join(self.near(lists), "s"), "set-open")

    def further(self, leaders: DataFrame, now: DataFrame) -> DataFrame:
        """Pairs of a list's leaders with its sets of other components that may link."""
        x = self.keep(leaders.select("s", *[F.col(c).alias(f"{c}_x") for c in ("key", "n", "reach", "comp", "na", "lacked", "extra")]), "set-leaders")

        def collisions(n: str, lacked: str, extra: str) -> Column:
            return F.col(n) - (F.col("na") - _ones(F.col(lacked))) - _ones(F.col(extra))

        of_lead = F.col("na") - _ones(F.zip_with("lacked", "lacked_x", lambda a, b: a.bitwiseOR(b)))
        others = _ones(F.zip_with("extra", "extra_x", lambda a, b: a.bitwiseAND(b))) + F.least(collisions("n", "lacked", "extra"), collisions("n_x", "lacked_x", "extra_x"))
        may = F.coalesce((100 + self.percent) * (of_lead + others) >= self.percent * (F.col("n") + F.col("n_x")), F.lit(True))  # not known of sets that did not fit the lead
        fit = now.join(self.near(x, BROADCAST_LEADERS), "s").where((F.col("comp") != F.col("comp_x")) & _fits(F.col("n"), F.col("reach"), F.col("n_x"), F.col("reach_x"), self.percent)).where(may)
        return fit.select(F.least("key", "key_x").alias("a"), F.greatest("key", "key_x").alias("b")).distinct()

    @staticmethod
    def drawn(key: str, salt: int, of: str, wanted: int) -> Column:
        """Whether an id is drawn: about ``wanted`` of as many as the column ``of`` says, all if there are no more."""
        return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 20)) * F.col(of) < F.lit(wanted << 20)

    def met(self, compared: DataFrame, now: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
        """``compared`` with the comparisons of the leaders of ``now`` with ``members`` that may link and are not done."""
        done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = self.further(now.where("leads"), members).join(done, ["a", "b"], "left_anti")
        return compared.unionByName(self.compared(pairs, nodes).drop(*KNOWN[1:]))

    def relabelled(self, now: DataFrame, labels: DataFrame) -> DataFrame:
        """``now`` with new components; what leads by then is of the list's largest one leads no more."""
        out = now
        for name, node in (("comp", "key"), ("most", "most")):
            new = labels.select(F.col("node").alias(node), F.col("comp").alias("new"))
            out = out.join(new, node, "left").withColumn(name, F.coalesce("new", name)).drop("new")
        return self.keep(out.withColumn("leads", F.col("leads") & (F.col("comp") != F.col("most"))), "set-leads-of")

    def run(self, sets: DataFrame) -> DataFrame:
        """(node, comp) of all sets that link another one, from the classes' sets."""
        led = self.led(self.held(sets))
        nodes = self.nodes(led)
        compared = self.compared(led.where("fits").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct(), nodes, derive=True)
        labels = self.labels(compared, 0)  # numbered on, two for a round
        often = self.keep(compared.groupBy("a", "b").count().where("count > 1").select("a", "b"), "set-often")  # ids with several texts
        once = compared.join(often, ["a", "b"], "left_anti").select(F.col("a").alias("lead"), F.col("b").alias("key"), *KNOWN)
        first = self.open_lists(led.where("rows > 2").select("s", "key", "n", "reach", "lead"), labels)
        held = first.join(once, ["lead", "key"], "left").select("s", "key", "n", "reach", *KNOWN)
        compared = compared.drop(*KNOWN[1:])
        leading, round_ = LEADERS, 0
        while not (now := self.open_lists(held, labels)).isEmpty():
            round_ += 1
            drawn = self.drawn("key", round_, "others", leading)
            now = self.keep(now.withColumn("leads", (F.col("comp") != F.col("most")) & drawn), "set-leads-of")
            compared = self.met(compared, now, now.where(self.drawn("key", -round_, "rows", PROBES)), nodes)
            now = self.relabelled(now, self.labels(compared, 2 * round_ - 1))  # most leaders are linked now; the others alone meet all
            compared = self.met(compared, now, now, nodes)
            labels = self.labels(compared, 2 * round_)
            held = self.keep(now.where("NOT leads").select("s", "key", "n", "reach", *KNOWN), "set-rest")
            leading *= 2
        self.keep.drop("set-held", "set-led", "set-keys", "set-texts", "set-compared", "set-open", "set-open-lists", "set-often", "set-pairs", "set-leads", "set-leads-of", "set-leaders", "set-rest", *[f"set-labels-{k}" for k in range(2 * round_)])
        return labels


def components_of(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    spark = df.sparkSession
    texts = _texts(df, key, text)
    job = Join(texts, size, percent)
    sketches = spark.sparkContext.broadcast(sketched(texts, size))  # of fixed size
    sets = job.keep(sets_of(texts, size, percent, sketches), "sets")
    twins = job.keep(sets.where("n > 0").groupBy("sig").agg(F.min("key").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("sig", "first"), "set-twins")
    classes = job.keep(sets.select("key", "n", "sig").join(twins, "sig", "left").select("key", "n", F.coalesce("first", "key").alias("rep")), "set-classes")
    firsts = sets.where("n > 0 AND key IS NOT NULL").join(twins, "sig", "left").where("first IS NULL OR first = key").select("key", "n", "prefix")
    labels = job.run(firsts)
    job.keep.drop("sets", "set-twins")
    out = classes.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    component = F.when(F.col("key").isNull(), None).when(F.col("n") > 0, F.coalesce("comp", "rep")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one of smallest id, with the columns of ``df``.

    Rows with a null id all stay. Of rows with one id that stays, each different text stays once.
    """
    keep = Scratch(df.sparkSession)
    found = components_of(df, key, text, size, percent).select(col(key).alias("k"), "component_id")
    gone = keep(found.where("k != component_id").select("k").distinct(), "near-copies")
    often = keep(found.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("rows")).where("rows > 1").select("k"), "repeated-ids")
    mark = free_name(df, "repeated_id")
    gone, often = (x.withColumnRenamed("k", mark) for x in (gone, often))
    mine = col(key).cast("long") == F.col(mark)
    once = df.join(gone.union(often), mine, "left_anti")
    return once.unionByName(df.join(often, mine, "left_semi").join(gone, mine, "left_anti").dropDuplicates([key, text]))
