"""Language identification by Bayesian evidence fusion.

The posterior of a language combines
- text: likelihood of the text's byte trigrams (hashed) under a model per language, tempered to TEXT_WEIGHT
  trigrams' worth, since neighbouring trigrams are not independent, against a background for no language at all;
- the declared markup language, right with probability DECLARED_RIGHT;
- the address suffix of the host, where it belongs to one language, right with probability SUFFIX_RIGHT;
- a prior of the host, smoothed towards its suffix' and that towards the whole corpus', from one grouped
  aggregation over what the text alone says of every document.

The trigram models are fitted on rows drawn by a hash of their key, about TRAIN_DOCS for each declared language;
everything else covers all rows. A document is rejected if it has no letters, if no language beats the background,
or if the best one's posterior is under MIN_POSTERIOR.

Null texts count as empty and are rejected; null or unknown declarations and hosts without a known suffix give no
evidence; a null host counts as the host ''. Repeated rows each give a row. Without any declared training row, all
languages have the same model and the other evidence decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import col, free_name, record, stored, text_slices, texts_of

LANGUAGES = ("de", "en", "es", "fr")
#: Address suffixes of one language.
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "es": "es", "mx": "es", "fr": "fr"}
#: Bound of the training sample for each language, in expectation.
TRAIN_DOCS = 1500
BUCKETS = 1 << 14
TEXT_WEIGHT = 60.0
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
#: Pseudo-counts of the next wider level in a host's and a suffix' prior.
HOST_KAPPA, SUFFIX_KAPPA = 20.0, 100.0
MIN_POSTERIOR = 0.5
#: Hosts with at least the LARGE_HOSTS-th part of all rows, so as many at most, are joined by broadcast: no task holds all rows of one.
LARGE_HOSTS = 1000
#: Prior probability of no language.
NO_LANGUAGE = 0.02

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(raw: bytes) -> np.ndarray:
    """Hashed trigrams of bytes in which all but lower-case letters are spaces; none of only spaces around."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.uint32)
    code = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(18))[(a[1:-1] != 32)]


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode().translate(_LETTERS) + b" "


def trained(df: DataFrame, text: str, declared: str, languages: Sequence[str], salt: Column, docs: int = TRAIN_DOCS) -> np.ndarray:
    """Log-probabilities by (bucket, language), the background last; fitted on about ``docs`` rows a language."""
    rows = df.where(col(declared).isin(*languages)).select(col(declared).cast("string").alias("label"), col(text).cast("string").alias("text"), salt.alias("salt"))
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    wanted = F.lit(False)
    for name, n in totals.items():
        share = min(1.0, docs / n)
        wanted = wanted | ((F.col("label") == name) & (F.pmod(F.col("salt"), F.lit(1 << 30)) < int(share * (1 << 30))))
    schema = pa.schema([("language", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])
    index = {name: k for k, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(index), BUCKETS), np.int64)
        for part in text_slices(batches):
            for label, t in zip(part.column("label").to_pylist(), texts_of(part), strict=True):
                seen[index[label]] += np.bincount(trigrams(prepared(t)), minlength=BUCKETS)
        where = np.nonzero(seen)
        yield record(schema, where[0].astype(np.int32), where[1].astype(np.int32), seen[where])

    found = rows.where(wanted).select("label", "text").mapInArrow(run, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found["bucket"].to_numpy(np.int64), found["language"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    counts += 0.5
    return np.column_stack([np.log(counts / counts.sum(0)), np.full(BUCKETS, -np.log(BUCKETS))]).astype(np.float32)


def text_evidence(df: DataFrame, model, key: str, text: str, declared: str, host: str, n_languages: int) -> DataFrame:
    """(key, declared, host, letters, scores): tempered log-likelihoods, the background's last."""
    schema = pa.schema([("key", pa.int64()), ("dig", pa.int64()), ("declared", pa.string()), ("host", pa.string()), ("letters", pa.int64()), ("scores", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for part in text_slices(batches, limit=1 << 20):
            codes = [trigrams(prepared(t)) for t in texts_of(part)]
            sizes = np.array([len(c) for c in codes], np.int64)
            flat = np.concatenate(codes)
            sums = np.zeros((len(codes), n_languages + 1))
            full = np.flatnonzero(sizes)
            if len(full):
                starts = (np.cumsum(sizes) - sizes)[full]
                for k in range(n_languages + 1):
                    sums[full, k] = np.add.reduceat(table[:, k][flat], starts, dtype=np.float64)
            sums *= (np.minimum(1.0, TEXT_WEIGHT / np.maximum(sizes, 1)))[:, None]
            offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * (n_languages + 1))
            yield record(schema, part.column("key"), part.column("dig"), part.column("declared"), part.column("host"), sizes, pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())))

    body = F.coalesce(col(text).cast("string"), F.lit(""))
    chosen = df.select(col(key).cast("long").alias("key"), F.xxhash64(body).alias("dig"), F.lower(col(declared).cast("string")).alias("declared"), F.lower(F.coalesce(col(host).cast("string"), F.lit(""))).alias("host"), body.alias("text"))
    return chosen.mapInArrow(run, "key long, dig long, declared string, host string, letters long, scores array<double>")


def identified(df: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source", languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """(key, dig, language, posterior, text_language, declared, accepted) of every row; language '' stands for none, dig is the text's xxhash64."""
    spark = df.sparkSession
    table = trained(df, text, declared, languages, F.xxhash64(col(key)))
    found = stored(text_evidence(df, spark.sparkContext.broadcast(table), key, text, declared, host, len(languages)), "language")
    names = [*languages, ""]
    suffix = F.when(F.col("host").contains("."), F.regexp_extract("host", r"\.([a-z]+)$", 1)).otherwise("")

    def best(scores: Column) -> Column:
        return F.when(F.col("letters") > 0, F.get(F.array(*map(F.lit, names)), F.array_position(scores, F.array_max(scores)).cast("int") - 1)).otherwise("")

    found = found.withColumn("suffix", suffix).withColumn("text_language", best(F.col("scores")))
    votes = [F.count(F.when(F.col("text_language") == name, 1)).cast("double").alias(f"n{k}") for k, name in enumerate(languages)]
    hosts = stored(found.groupBy("host", "suffix").agg(F.count("*").alias("rows"), *votes), "hosts")  # a row for each host
    sums = [F.sum(f"n{k}").alias(f"s{k}") for k in range(len(languages))]
    suffixes = hosts.groupBy("suffix").agg(*sums)
    *whole, n_rows = hosts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0.0)) for k in range(len(languages))], F.coalesce(F.sum("rows"), F.lit(0))).first()
    total = sum(whole) + len(languages)
    prior = hosts.join(suffixes, "suffix")
    n, s = (sum((F.col(f"{x}{k}") for k in range(len(languages))), F.lit(0.0)) for x in "ns")
    logs = []
    for k in range(len(languages)):
        wide = (F.col(f"s{k}") + SUFFIX_KAPPA * (whole[k] + 1.0) / total) / (s + SUFFIX_KAPPA)
        logs.append(F.log((1 - NO_LANGUAGE) * (F.col(f"n{k}") + HOST_KAPPA * wide) / (n + HOST_KAPPA)))
    prior = stored(prior.select("host", (F.col("rows") * LARGE_HOSTS >= F.lit(n_rows)).alias("large"), F.array(*logs, F.log(F.lit(NO_LANGUAGE))).alias("prior")), "priors")

    def likelihood(known: Column, means: Column, right: float, name: str) -> Column:
        if not name:
            return F.lit(0.0) + F.when(known, F.log(F.lit(1.0 / len(languages)))).otherwise(0.0)
        wrong = (1 - right) / max(1, len(languages) - 1)
        return F.when(known, F.log(F.when(means == name, right).otherwise(wrong))).otherwise(0.0)

    large = F.broadcast(prior.where("large").drop("large"))  # LARGE_HOSTS rows at most
    joined = found.join(large, "host").unionByName(found.join(F.broadcast(prior.where("large").select("host")), "host", "left_anti").join(prior.where("NOT large").drop("large"), "host"))
    belongs = F.lit(None).cast("string")
    for name, language in SUFFIXES.items():
        belongs = F.when(F.col("suffix") == name, language).otherwise(belongs)
    known = F.coalesce(F.col("declared").isin(*languages), F.lit(False))
    fused = [F.get("scores", F.lit(k)) + F.get("prior", F.lit(k)) + likelihood(known, F.col("declared"), DECLARED_RIGHT, name) + likelihood(belongs.isin(*languages), belongs, SUFFIX_RIGHT, name) for k, name in enumerate(names)]
    joined = joined.withColumn("fused", F.array(*fused))
    top = F.array_max("fused")
    joined = joined.withColumn("posterior", F.when(F.col("letters") > 0, 1 / F.aggregate(F.transform("fused", lambda x: F.exp(x - top)), F.lit(0.0), lambda acc, x: acc + x)).otherwise(0.0)).withColumn("language", best(F.col("fused")))
    accepted = (F.col("language") != "") & (F.col("posterior") >= MIN_POSTERIOR)
    return joined.select(F.col("key").alias(key), "dig", "language", "posterior", "text_language", "declared", accepted.alias("accepted"))


def kept(df: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """The rows of ``df`` that are accepted, with their columns; rows of equal id and text share their fate."""
    verdicts = identified(df, key, text, declared, host)
    k, d = free_name(df, "rejected_key"), free_name(df, "rejected_dig")
    gone = stored(verdicts.where("NOT accepted").select(col(key).alias(k), F.col("dig").alias(d)).distinct(), "rejected")
    same = col(key).cast("long").eqNullSafe(F.col(k)) & (F.xxhash64(F.coalesce(col(text).cast("string"), F.lit(""))) == F.col(d))
    return df.join(gone, same, "left_anti")
