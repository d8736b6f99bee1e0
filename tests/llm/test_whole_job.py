"""Whole jobs of the training-data operators: planted cases that a cut would miss."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tesselon.llm import language_id, quality_rules  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string"


def prose(r, n, symbols=0):
    words = [r.choice("abcdefghij") + "".join(r.choice("klmnopqrst") for _ in range(r.randint(1, 7))) for _ in range(n)]
    for _ in range(symbols):
        words[r.randrange(n)] += "#$%*"
    return " ".join(words)


def test_quality_rejects_planted_junk_in_small_strata(spark):
    r = random.Random(5)
    docs, labels, junk = [], [], set()
    for k in range(1200):
        bad = k % 10 == 0
        junk |= {k} if bad else set()
        lang = "unseen" if k >= 1190 else "en" if k % 3 else "de" if k % 2 else "es"
        docs.append((k, prose(r, 80, 30 if bad else k % 2), lang, "h"))
        if k < 700:
            labels.append((k, int(not bad), 0))
    found = quality_rules.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    seen = {d for d, _, lang, _ in docs if lang != "unseen"}
    assert not any(x["base_failed"] for x in found)
    assert {x["doc_id"] for x in found if not x["kept"]} == junk & seen


def test_quality_bounds_the_combined_rejection():
    n = quality_rules.least_rows(0.01, 0.05)
    assert (n, quality_rules.least_rows(0.01, 0.0125)) == (299, 437)
    assert quality_rules.groups({"a": 500, "b": 450, "c": 10, "d": 5}) == ([(["a"], ["a"]), (["b"], ["b"]), (["c", "d"], ["a", "b", "c", "d"])], 0.05 / 3)
    path = [(0, 38), (3, 37)]  # steps: rule 0 at 1.0, 0.975; rule 3 at 1.0, 0.975, 0.95
    steps = {"a": np.array([0, 0, 0, 0, 9, 2000])}
    assert quality_rules.cutoffs(steps, path) == [(["a"], {"symbol_ratio": 0.975, "caps_ratio": 0.95})]
    steps = {"a": np.array([0, 9, 0, 9, 0, 2000])}  # each rule alone loses under a hundredth, both too much
    assert quality_rules.cutoffs(steps, path) == [(["a"], {"symbol_ratio": 0.975, "caps_ratio": 1.0})]
    assert quality_rules.cutoffs({"a": np.array([0, 0, 0, 0, 0, n - 1])}, path) == [(["a"], {})]


def test_near_copies_are_of_five_words(spark):
    r = random.Random(7)
    docs = []
    for _ in range(8):
        base = prose(r, 49).split()
        for changed in ((), (24,), (9, 24, 39)):  # 40 of 50 shingles of five words and 42 of 50 of four; far fewer
            docs.append(" ".join(f"new{len(docs)}" if k in changed else x for k, x in enumerate(base)))
    docs = list(enumerate(docs))
    want = {d for d, (_, comp) in brute.op10(docs, 5, 80).items() if d == comp}
    assert len(want) < len({comp for _, comp in brute.op10(docs).values()})
    df = spark.createDataFrame([(k, t, "en", "h") for k, t in docs], DOCS)
    assert {x["doc_id"] for x in corpus_pipeline.near_copies(spark, df, "").collect()} == want


def test_address_suffixes_decide_between_equal_texts(spark):
    hosts = {"a.fr": "fr", "b.co.uk": "en", "C.ES": "es", "src0": "de"}  # src0: no suffix, the first of equal languages
    df = spark.createDataFrame([(k, "abc xyz", None, h) for k, h in enumerate(hosts)], DOCS)
    found = {x["doc_id"]: x["language"] for x in language_id.identified(df).collect()}
    assert [found[k] for k in range(4)] == list(hosts.values())


def plain_posterior(text, declared, host, table, votes, suffix_votes, whole):
    """The fusion for one document with letters, by loops."""
    import math

    languages = [*language_id.LANGUAGES, ""]
    codes = language_id.trigrams(language_id.prepared(text)).tolist()
    suffix = host.rsplit(".", 1)[1] if "." in host else ""
    n, s, total = sum(votes), sum(suffix_votes), sum(whole) + 4
    fused = []
    for k, name in enumerate(languages):
        x = sum(float(table[c, k]) for c in codes) * min(1, language_id.TEXT_WEIGHT / len(codes))
        if name:
            wide = (suffix_votes[k] + language_id.SUFFIX_KAPPA * (whole[k] + 1) / total) / (s + language_id.SUFFIX_KAPPA)
            x += math.log((1 - language_id.NO_LANGUAGE) * (votes[k] + language_id.HOST_KAPPA * wide) / (n + language_id.HOST_KAPPA))
        else:
            x += math.log(language_id.NO_LANGUAGE)
        for known, means, right in ((declared in languages[:4], declared, language_id.DECLARED_RIGHT), (suffix in language_id.SUFFIXES, language_id.SUFFIXES.get(suffix), language_id.SUFFIX_RIGHT)):
            if known:
                x += math.log(0.25 if not name else right if means == name else (1 - right) / 3)
        fused.append(x)
    top = max(fused)
    return languages[fused.index(top)], 1 / sum(math.exp(x - top) for x in fused)


def test_language_fusion_equals_a_plain_version(spark):
    r = random.Random(11)
    stems = {"de": "schungenichtderundkeit", "en": "thewithingtionandough", "es": "cionesparaquelosmente", "fr": "eauxlesdansquetionoir"}
    rows = []
    for k in range(120):
        lang = r.choice(sorted(stems))
        text = " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(2, 8))) for _ in range(r.randint(1, 40)))
        declared = r.choice([lang, lang, lang, r.choice(sorted(stems)), None, "xx"])  # some are wrong
        rows.append((k, text, declared, r.choice(["a.de", "b.co.uk", "c.es", "src0", "src0", "src1"])))
    rows += [rows[0], (900, None, None, None), (901, "123 !", "en", "a.de"), (None, rows[1][1], "en", "src1")]
    df = spark.createDataFrame([(*x, "z") for x in rows], DOCS + ", language string")
    found = language_id.identified(df).collect()
    assert len(found) == len(rows)
    from pyspark.sql import functions as F

    table = language_id.trained(df, "text", "lang", language_id.LANGUAGES, F.xxhash64("doc_id"))
    said = {(x["doc_id"], x["dig"]): x["text_language"] for x in found}
    digs = {x["doc_id"]: x["dig"] for x in found}
    counts, suffixes = {}, {}
    for k, _, _, h in rows:
        h = h or ""
        language = said[k, digs[k]]
        for group, name in ((counts, h), (suffixes, h.rsplit(".", 1)[1] if "." in h else "")):
            votes = group.setdefault(name, [0] * 4)
            if language:
                votes[language_id.LANGUAGES.index(language)] += 1
    whole = [sum(v[k] for v in counts.values()) for k in range(4)]
    for x in found:
        k, text, declared, h = next(y for y in rows if y[0] == x["doc_id"])
        if not text or text == "123 !":
            assert not x["accepted"] and x["language"] == ""
            continue
        name, posterior = plain_posterior(text, declared, h, table, counts[h], suffixes[h.rsplit(".", 1)[1] if "." in h else ""], whole)
        assert (x["language"], x["accepted"]) == (name, name != "" and posterior >= language_id.MIN_POSTERIOR) and abs(x["posterior"] - posterior) < 1e-5
    kept = language_id.kept(df.withColumnRenamed("language", "rejected_key"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "rejected_key"] and kept.count() == sum(x["accepted"] for x in found)


def test_a_benchmark_of_many_blocks(spark, monkeypatch):
    from tesselon.llm import decontaminate

    r = random.Random(12)
    items = [(k, prose(r, 12)) for k in range(9)]
    docs = [(k, f"{prose(r, 5)} {items[k % 9][1]} {items[(k * 2) % 9][1]}" if k % 2 else prose(r, 30)) for k in range(12)] + [(12, None)]
    df = spark.createDataFrame([(*d, "hits") for d in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = decontaminate.blocks_of
    monkeypatch.setattr(decontaminate, "blocks_of", lambda *a: blocks(*a, limit=300))
    assert len(list(decontaminate.blocks_of(bench, "item_id", "text"))) > 3
    assert {x["doc_id"]: tuple(x)[1:6] for x in decontaminate.report(df, bench).collect()} == brute.op8(docs, items)


def test_quality_of_a_text_with_many_different_words():
    words = [f"w{k}" for k in range(2_200_000)]
    found = quality_rules.counts_of(" ".join([*words, "w1", "w2", "w3"]))
    assert found[0] == len(words) + 3 and found[4] == 6


def test_quality_risk_by_simulation():
    """Over many draws of labels, cutoffs reject more than alpha of the good documents in at most delta of them, with room for chance."""
    r = np.random.default_rng(3)
    alpha, delta, draws, bad = 0.05, 0.1, 400, 0
    path = [(0, 20)]
    for _ in range(draws):
        true = r.dirichlet(np.full(len(quality_rules.GRID) - 20 + 1, 0.3) * np.append(np.full(20, 0.2), 12))  # share of good ones by the step that rejects them first
        steps = {"a": r.multinomial(300, true)}
        (_, passed), = quality_rules.cutoffs(steps, path, alpha, delta)
        if passed:
            last = len(quality_rules.GRID) - 1 - quality_rules.GRID.index(passed["symbol_ratio"])
            bad += true[: last + 1].sum() > alpha
    assert bad <= delta * draws + 3 * (delta * (1 - delta) * draws) ** 0.5


def test_near_copies_with_nulls_repeats_and_clashing_names(spark):
    r = random.Random(13)
    a, b, c = prose(r, 60), prose(r, 60), prose(r, 60)
    docs = [(1, a, "x"), (2, a, "y"), (2, a, "y"), (3, b, "x"), (3, b, "z"), (4, None, None), (4, None, None), (None, a, "n"), (None, a, "n"), (5, "", "e"), (6, c, "r"), (6, f"{c} end", "r")]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, repeated_id string, k string")
    kept = sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.near_copies(spark, df, "").collect()), key=str)
    assert kept == sorted([(1, a), (3, b), (4, None), (5, ""), (6, c), (6, f"{c} end"), (None, a), (None, a)], key=str)


def test_pipeline_run_on_planted_documents(spark, tmp_path):
    import hashlib

    from tokenizers import Tokenizer

    from tesselon.llm.queries import vocabulary

    r = random.Random(9)
    one, two = prose(r, 10), prose(r, 10)
    base = prose(r, 49).split()
    plain, cut = prose(r, 60), (prose(r, 30) + " ", " " + prose(r, 30))
    docs = [plain, None, "12 34", " ".join(base), " ".join("new" if k == 24 else x for k, x in enumerate(base)), plain, f"{prose(r, 20)} {one} x {two}", one.join(cut)]
    rows = [(k, t, "en", "h", len(t or "")) for k, t in enumerate(docs)]
    spark.createDataFrame(rows, f"{DOCS}, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, one), (2, two)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    byte = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {}
    for k, t in {0: plain, 3: docs[3], 7: "".join(cut)}.items():
        ids = byte.encode(t, add_special_tokens=False).ids
        want[k] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), t)))
    assert {x["doc_id"]: tuple(x)[1:] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
