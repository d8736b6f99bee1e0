"""The training-data queries against plain versions, over small tables with nulls, repeats and odd texts."""

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tesselon.llm import bpe_codec, decontaminate, html_text, huffman_ids, language_id, ngram_join, pii, quality_rules, substring_dedup, token_counts  # noqa: E402
from tesselon.llm.common import scratch_path  # noqa: E402
from tesselon.llm.queries import vocabulary  # noqa: E402

LONG = " ".join(f"w{k * 7919 % 997}" for k in range(6000))
ODD = [None, "", " \n\t ", "<|endoftext|> a<|startoftext|>", "ΑΣ Σ ﬁ İx é Å", "aaaaaaaaaaaa bbbb don't I'LL 12345 ٣", "😀👍🏽 日本語", "\x00\x01 \x0b\x1c x", LONG]


def copies(seed=1, groups=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(70)]
    out = [None, "", "one two", "one two", LONG]
    for _ in range(groups):
        base = [word() for _ in range(r.randint(30, 160))]
        if r.random() < 0.5:
            base[10:10] = passage
        for _ in range(r.randint(1, 7)):
            text = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                text[r.randrange(len(text))] = word()
            out.append(" ".join(text))
    return list(enumerate(out))


def family(first, seed=4, n=40, words=90, edits=4):
    """Texts that differ from one base by so many words that some link, some don't, and lists of them stay open."""
    r = random.Random(seed)
    base = [f"x{k}" for k in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(r.randint(1, edits)):
            text[r.randrange(words)] = f"y{r.randrange(40)}"
        out.append((first + k, " ".join(text)))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "h.example", 1) for k, t in texts], "doc_id long, text string, lang string, source string, key int")


def test_encoders(spark):
    from tokenizers import Tokenizer

    df = frame(spark, list(enumerate(ODD)))
    word, byte = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = [len(word.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    assert [r["n_tokens"] for r in token_counts.count_tokens(df, vocabulary("word_bpe_49k.json")).orderBy("doc_id").collect()] == want
    for r, t in zip(bpe_codec.round_trip(df, vocabulary("byte_bpe_50k.json")).orderBy("doc_id").collect(), ODD, strict=True):
        ids = byte.encode(t or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    path = huffman_ids.encode_to_files(df, scratch_path(spark, "files"), vocabulary("word_bpe_49k.json"))
    start = 0
    for r, t in zip(huffman_ids.read_files(spark, path).orderBy("doc_id").collect(), ODD, strict=True):
        ids = np.array([*word.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (r["start"], r["ids_crc32"], bytes(r["ids"])) == (start, zlib.crc32(ids), ids)
        start += len(ids) // 4


def test_code_lengths_are_limited_and_complete():
    counts = np.array([2**k for k in range(20)] + [0])
    lengths = huffman_ids.code_lengths(counts, 8)
    assert lengths.max() == 8 and lengths[-1] == 0 and sum(2.0**-n for n in lengths[:-1]) == 1


@pytest.mark.parametrize("seed", (1, 2))
def test_substrings(spark, seed):
    docs = copies(seed)
    found = substring_dedup.deduplicated(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == brute.op3(docs)
    words = {d: (t or "").split() for d, t in docs}
    for r in found:  # each factor is in an earlier document, and ends where that one's words differ or end
        for f in r["factors"]:
            assert f["doc"] < r["doc_id"] and f["to"] - f["from"] >= substring_dedup.WINDOW
            assert words[r["doc_id"]][f["from"] : f["to"]] == words[f["doc"]][f["place"] : f["place"] + f["to"] - f["from"]]


@pytest.mark.parametrize("leaders", (ngram_join.LEADERS, 1))
def test_ngrams(spark, leaders, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    docs = [*copies(3, 6), *family(300)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components_of(frame(spark, docs)).collect()}
    assert got == brute.op10(docs)


def test_rows(spark):
    texts = [*ODD, "a@b.com_x@y.org 10.0.0.1 1.2.3.4.5.6.7.8 999.1.1.1 4785 3805 9239 1135", "+1 (555) 123-4567 +1 2", "1" * 3000, "a" * 5000 + "@x", "bank IBAN GB82 WEST 1234 5698 7654 32", "x\nx\ny\nx", "a b c a b c " * 30]
    docs = list(enumerate(texts))
    df = frame(spark, docs)
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert {k: tuple(r)[1:6] for k, r in got.items()} == {k: brute.op9(t)[:5] for k, t in docs}
    assert "iban:10:37" in got[len(ODD) + 4]["spans"]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(5)], "doc_id long, quality int, toxic int")
    for r in quality_rules.judged(df, labels).collect():
        assert tuple(r)[1:7] == brute.op4(texts[r["doc_id"]])
    items = [(1, "w0 w942 w887 w832 w777 w722 w667 w612 w557"), (2, "one two"), (3, None), (4, "")]
    docs2 = [*docs, (90, "x One TWO y"), (91, LONG.replace("w887", "zz"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:6] for r in decontaminate.report(frame(spark, docs2), bench).collect()} == brute.op8(docs2, items)
    found = {r["doc_id"]: r["accepted"] for r in language_id.identified(df).collect()}
    assert not found[0] and not found[1] and found[8] is not None


def test_many_spans_in_one_text(spark):
    import time

    text = " \u00e9 ".join(f"u{k}@h.example 10.0.{k % 256}.1" for k in range(30000))
    df = frame(spark, [(1, text), (2, None), (1, text[:200]), (3, "a@b.c"), (4, "x" * 5000 + " a@b.cd,+1 555 123 4567 " + "\u00e9" * 3000 + " 1.2.3.4@h.com")])
    df = df.withColumn("n_chars", df.key.cast("long")).withColumn("pii", df.key)
    began = time.perf_counter()
    got = {(r["doc_id"], r["n_email"], r["base_sha256"]) for r in pii.report(df).collect()}
    assert got == {(k, brute.op9(t)[0], brute.op9(t)[4]) for k, t in ((r["doc_id"], r["text"]) for r in df.collect())}
    masked = {r["text"] for r in pii.masked(df).collect()}
    assert time.perf_counter() - began < 90
    assert " \u00e9 ".join(["<EMAIL> <IP>"] * 30000) in masked and "<EMAIL>" in masked and None in masked
    assert "x" * 5000 + " <EMAIL>,<PHONE> " + "\u00e9" * 3000 + " <IP>" in masked


def test_page():
    page = "<html><body><nav><a href=x>m</a></nav><div class='ad'>buy</div><article><h1>T &amp; u</h1><p><b>One,<br>two<p>Three  \n four<ul><li>x</ul></article><div id=comments><p>no</p></div><footer>f</footer></body></html>"
    assert html_text.main_text(page) == "T & u\nOne, two\nThree four\nx"
    assert html_text.main_text("") == "" and html_text.main_text("<!-- open") == ""


def prose(k, n=30):
    return " ".join(f"w{(k * 31 + i * 17) % 97}" + "," * (i % 7 == 0) for i in range(n))


def test_page_wrappers_names_and_siblings():
    a, b = prose(1), prose(2)
    text = html_text.main_text
    assert text(f'<body><div id="page-with-sidebar"><article><p>{a}</p></article><div class="sidebar"><p>{b}</p></div></div>') == a
    assert text(f'<body><div class="has-comments no-menu"><p>{a}</p><p>{b}</p></div>') == f"{a}\n{b}"
    assert text(f'<body><div class="header-main"><h1>T</h1><p>{a}</p></div>') == f"T\n{a}"
    assert text(f'<body><article><p title="no hidden agenda here">{a}</p><p class="search-terms">{b}</p></article>') == f"{a}\n{b}"
    assert text(f'<body><article><p hidden>{a}</p><p style="display: none">{a}</p><p class=notice>{a}</p><p>{b}</p></article>') == b
    assert text(f'<body><div><article><p>{a}</p></article><article><p>{b}</p></article><article class="comment"><p>{b}</p></article></div>') == f"{a}\n{b}"
    assert text(f"<body><article><header><h1>T</h1></header><p>{a}</p></article>") == a
    deep = "<div>" * 3000 + f"<p>{a}</p>" + "</div>" * 3000
    assert text(deep) == a
    assert text(f"<body><article><p>{a}</p><a b='") == a


def plain_page(title, paragraphs, noise):
    """A page of known text, and that text: no tree, no scores."""
    out = ["<!DOCTYPE html><html><head><title>x</title><script>if (a < b) '</p>'</script><style>p{}</style></head><body>"]
    out.append(f"<nav><ul><li><a href=/>{noise}</a></li></ul></nav><div class='ad'>{noise}</div><article><h1>{title}</h1>")
    out += [f"<p>{p.replace('&', '&amp;').replace('<', '&lt;')}" + "</p>" * (k % 2) + "<!-- c -->" for k, p in enumerate(paragraphs)]
    out.append(f"</article><section id='comments'><p>{noise}</p></section><aside>{noise}</aside><form><p>{noise}</p></form><footer>{noise}</footer></body></html>")
    return "".join(out), "\n".join([title, *(" ".join(p.split()) for p in paragraphs)])


def test_pages_of_known_text(spark):
    r = random.Random(8)
    pages = [plain_page(prose(k, 4), [prose(k * 9 + j, r.randint(5, 60)).replace("w1", "&<\u00e9") + "  \n x" for j in range(r.randint(1, 8))], prose(k + 50, r.randint(1, 40))) for k in range(40)]
    rows = [(k, "u", p) for k, (p, _) in enumerate(pages)] + [(100, None, None), (101, "u", ""), (0, "u", pages[0][0])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, text int")
    found = html_text.extracted(df).collect()
    want = {k: t for k, (_, t) in enumerate(pages)} | {100: "", 101: ""}
    assert len(found) == len(rows) and all((x["text"], x["n_chars"]) == (want[x["page_id"]], len(want[x["page_id"]])) for x in found)


def test_empty_tables(spark):
    df = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    path = huffman_ids.encode_to_files(df, scratch_path(spark, "none"), vocabulary("word_bpe_49k.json"))
    for out in (substring_dedup.deduplicated(df), ngram_join.components_of(df), pii.report(df), quality_rules.judged(df, labels), decontaminate.report(df, bench), language_id.identified(df), huffman_ids.read_files(spark, path)):
        assert out.count() == 0
