"""Quality rules with risk-controlled thresholds.

Every rule is a ratio of the text; a document goes if a ratio exceeds its cutoff. Cutoffs come from labelled rows that
pass the base rule, in two steps on different rows:

- The rows labelled bad and the rows without a label give a path: one sequence of lower and lower cutoffs, rule after
  rule, that rejects many bad rows early and few others.
- The rows labelled good test the path. At each step the share of good documents that all rules reject together is
  tested exactly (binomial tail) against ``alpha``; the path ends at the first step that fails. The path does not depend
  on the rows that test it, so its tests need no correction for their number, nor ``alpha`` a split over rules.

Strata with enough good rows are tested alone, each at an equal part of ``delta``. The other strata that have good rows
are tested as one pool, or, where that is too small as well, get the cutoffs that hold for the whole corpus. So if
labels are drawn independently, with probability 1 - delta the rules reject at most ``alpha`` of the good documents in
each stratum tested alone, and at most ``alpha`` of those of the pool, or of the corpus, in the small strata together;
no bound holds for a small stratum alone. A test needs least_rows(alpha, delta / tests) good rows to pass.

Null texts have no words and fail the base rule. A null stratum is the stratum ''. Strata without good rows get no
cutoffs and keep what the base rule keeps. Repeated rows each give a row and each count; a row with labels of both
kinds is good. If labels leave fewer rows unlabelled than they call good, a fifth of the good rows, drawn by a hash of
the key, helps to find the path and not to test it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import col, record, stored, text_slices, texts_of

#: Largest share of good documents that may be rejected, and the probability that this fails.
ALPHA, DELTA = 0.01, 0.05
#: Cutoffs that are tested for each rule.
GRID = tuple(k / 40 for k in range(1, 41))
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "caps_ratio", "long_word_ratio")
MIN_WORDS = 50

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_CAPS = bytes(range(65, 91))
_TAIL = bytes(range(128, 192))
_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_lines", pa.int64()), ("n_caps", pa.int64()), ("n_long", pa.int64())]
_SCHEMA = pa.schema([("key", pa.int64()), ("stratum", pa.string()), *_FIELDS])
_SQL = "key long, stratum string, " + ", ".join(f"{n} long" for n, _ in _FIELDS)


def repeated(ids: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more; ids count from 0."""
    n = len(ids) - 2
    if n < 2:
        return 0
    top = int(ids.max()) + 1  # products stay under 2^63 for texts of under three billion words
    pairs = np.unique(ids[:-2] * top + ids[1:-1], return_inverse=True)[1]
    keys = pairs * top + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    often = np.zeros(n + 4, np.int8)
    at = order[np.append(same, False) | np.append(False, same)]
    if not len(at):
        return 0
    often[at] = often[at + 1] = often[at + 2] = 1
    return int(often.sum())


def counts_of(text: str) -> list[int]:
    raw = text.encode()
    bare = raw.translate(None, _SPACE)
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.translate(None, _SPACE)]
    return [
        len(words),
        len(bare.translate(None, _TAIL)),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(ids),
        len(lines),
        len(raw) - len(raw.translate(None, _CAPS)),
        sum(len(w) > 40 for w in seen),
    ]


def features(df: DataFrame, key: str, text: str, stratum: str) -> DataFrame:
    """(key, stratum, counts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = list(zip(*map(counts_of, texts_of(part)), strict=True))
            yield record(_SCHEMA, part.column("key"), part.column("stratum").fill_null(""), *[list(x) for x in found])

    return df.select(col(key).cast("long").alias("key"), col(stratum).cast("string").alias("stratum"), col(text).cast("string").alias("text")).mapInArrow(run, _SQL)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {
        "symbol_ratio": share("n_symbols", "word_chars"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "repeat_ratio": share("n_repeat_words", "n_words"),
        "caps_ratio": share("n_caps", "word_chars"),
        "long_word_ratio": share("n_long", "n_words"),
    }


def _bin(ratio: Column) -> Column:
    """How many cutoffs of the grid the ratio exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, GRID)), lambda c: ratio > c))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X, exactly."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i.tolist()])
    return float(min(1.0, np.exp(np.logaddexp.reduce(choose + i * math.log(p) + (n - i) * math.log1p(-p)))))


def least_rows(alpha: float, level: float) -> int:
    """The fewest good rows, none of them rejected, that bound the rejected share by ``alpha`` at ``level``."""
    n = max(1, math.ceil(math.log(level) / math.log1p(-alpha)) - 1)
    while tail(0, n, alpha) > level:
        n += 1
    return n


def groups(counts: dict[str, int], alpha: float = ALPHA, delta: float = DELTA) -> tuple[list[tuple[list[str], list[str]]], float]:
    """(strata that get the cutoffs, strata whose good rows test them) of each test, and the level of a test."""
    names = sorted(counts, key=lambda x: (-counts[x], x))
    for alone in range(len(names), -1, -1):
        small = names[alone:]
        level = delta / max(1, alone + bool(small))
        need = least_rows(alpha, level)
        if all(counts[x] >= need for x in names[:alone]):
            break
    out = [([x], [x]) for x in names[:alone]]
    if small:
        out.append((small, small if sum(counts[x] for x in small) >= need else names))
    return out, level


def path_of(bins: DataFrame, alpha: float = ALPHA) -> list[tuple[int, int]]:
    """(rule, last cutoff) by place in RULES and GRID, in the order of the path, from (kind, a bin a rule, n).

    Each round takes the rule and cutoff that reject most of the bad rows still there, less what they seem to reject of
    good ones; rows without a label hold bad ones too, in the share that labels tell. A round is one small aggregation.
    """
    last = len(GRID)
    totals = {r["kind"]: r["n"] for r in bins.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    bad, rest = totals.get("bad", 0), totals.get("rest", 0)
    if not bad:
        return []
    mixed = bad / (bad + totals.get("good", 0)) if rest else 0.0
    path: list[tuple[int, int]] = []
    left = bins.where("kind != 'good'")
    while len(path) < len(RULES):
        found = np.zeros((2, len(RULES), last + 1))
        rows = left.select("kind", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(r).alias("bin")) for k, r in enumerate(RULES)])).alias("x"))
        for r in rows.groupBy("kind", "x.rule", "x.bin").agg(F.sum("n").alias("n")).collect():
            found[int(r["kind"] == "rest"), r["rule"], r["bin"]] = r["n"]
        above = found[:, :, ::-1].cumsum(2)[:, :, ::-1][:, :, 1:]  # rows over each cutoff
        hit = above[0] / bad
        lost = np.maximum(0.0, above[1] / max(1, rest) - mixed * hit) / max(1e-9, 1 - mixed)
        gain = hit - lost / (10 * alpha)
        gain[[r for r, _ in path]] = 0
        rule, back = divmod(int(gain[:, ::-1].argmax()), last)  # of equal ones the highest cutoff
        if gain[rule, last - 1 - back] <= 0:
            break
        path.append((rule, last - 1 - back))
        left = left.where(F.col(RULES[rule]) <= last - 1 - back)
    return path


def cutoffs(steps: dict[str, np.ndarray], path: list[tuple[int, int]], alpha: float = ALPHA, delta: float = DELTA) -> list[tuple[list[str], dict[str, float]]]:
    """(strata, cutoff by rule) of each test, from how many good rows each step rejects first; the last entry counts the others."""
    tests, level = groups({k: int(x.sum()) for k, x in steps.items()}, alpha, delta)
    walk = [(rule, k) for rule, end in path for k in range(len(GRID) - 1, end - 1, -1)]
    out = []
    for strata, by in tests:
        first = sum((steps[x] for x in by), np.zeros(len(walk) + 1, np.int64))
        n, gone, passed = int(first.sum()), 0, {}
        for (rule, k), more in zip(walk, first[:-1].tolist(), strict=True):
            gone += more
            if gone > alpha * n or tail(gone, n, alpha) > level:
                break
            passed[RULES[rule]] = GRID[k]
        out.append((strata, passed))
    return out


def calibrated(found: DataFrame, labels: DataFrame, label_key: str = "doc_id", label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> list[tuple[list[str], dict[str, float]]]:
    """(strata, cutoff by rule) from the rows of ``found`` that pass the base rule; a row for each stratum and step to the driver."""
    marks = labels.where(col(label).isin(0, 1)).groupBy(col(label_key).cast("long").alias("key")).agg(F.max(col(label).cast("int")).alias("label"))
    passing = found.where(~base_failed())
    kind = F.when(F.col("label") == 1, "good").when(F.col("label") == 0, "bad").otherwise("rest")
    fifth = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
    bins = passing.join(marks, "key", "left").select("stratum", kind.alias("kind"), fifth.alias("fifth"), *[_bin(r).alias(name) for name, r in ratios().items()])
    bins = stored(bins.groupBy(*bins.columns).agg(F.count("*").alias("n")), "quality-bins")
    totals = {r["kind"]: r["n"] for r in bins.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    if totals.get("rest", 0) < totals.get("good", 0):
        bins = bins.withColumn("kind", F.when((F.col("kind") == "good") & F.col("fifth"), "rest").otherwise(F.col("kind")))
    path = path_of(bins, alpha)
    at, places = 0, []
    for rule, end in path:
        bin_ = F.col(RULES[rule])
        places.append(F.when(bin_ > end, at + len(GRID) - bin_))
        at += len(GRID) - end
    first = F.coalesce(F.array_min(F.array(*places)), F.lit(at)) if places else F.lit(at)
    steps: dict[str, np.ndarray] = {}
    for r in bins.where("kind = 'good'").groupBy("stratum", first.alias("step")).agg(F.sum("n").alias("n")).collect():
        steps.setdefault(r["stratum"], np.zeros(at + 1, np.int64))[r["step"]] = r["n"]
    return cutoffs(steps, path, alpha, delta)


def judged(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(key, counts, base_failed, kept) of every row."""
    spark = df.sparkSession
    found = stored(features(df, key, text, stratum), "quality")
    limits = [(name, *(passed.get(rule) for rule in RULES)) for strata, passed in calibrated(found, labels, alpha=alpha, delta=delta) for name in strata if passed]
    known = spark.createDataFrame(limits, "stratum string, " + ", ".join(f"max_{rule} double" for rule in RULES))  # a row for each stratum
    over = F.lit(False)
    for rule, ratio in ratios().items():
        over = over | F.coalesce(ratio > F.col(f"max_{rule}"), F.lit(False))
    joined = found.join(known, "stratum", "left")
    return joined.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"))
