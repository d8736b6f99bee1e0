"""Personal data by regular expressions, checksums and context words, in DataFrame expressions alone.

Expressions propose spans; validators confirm them (parts of an address, Luhn for cards, mod 97 for IBANs, digit
counts); words near a span raise its score. The four base kinds are kept as the validators say; kinds that the
method adds must also reach a score.

Positions are code points, ends exclusive. Null texts count as empty and have no spans; repeated rows each give a
row. The expressions use possessive loops and start only where a run of their characters starts, so a very long
run costs time in proportion and no stack. Texts are cut at the matches once; places are running sums over the pieces,
kept in groups, so a text with very many spans costs little more than in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import col, free_name

#: Patterns by kind. Each proposes the same spans as its plain form, without backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+-])(?:\([0-9]{3}\) |[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"

#: Words whose presence shortly before or after a span raises its score, by kind.
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|appel",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
    "tel": "phone|tel|call|mobile|fax|telefon|appel",
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "tel")
#: Score before context, what context adds, and what an added span needs. A checksum alone is enough, a form alone is not.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "tel": 0.3}
CONTEXT_GAIN, NEEDED, CONTEXT_CHARS = 0.3, 0.6, 40
#: Spans whose lengths are added up in one go; sums over such groups keep the cost of a text with many spans near linear.
GROUP = 64
#: Code points of the chunks that masked texts are cut into, small ones from large ones: a cut walks its text from the start.
CHUNK, CHUNKS = 1 << 10, 64

_SPAN = "struct<kind:string,start:int,end:int,score:double>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its check: 1 modulo 97 with the first four characters last."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda acc, x: (acc * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    size = F.length(_digits(match))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(F.regexp_replace(match, "(?<![0-9])0+(?=[0-9])", ""), "\\."), lambda part: F.when(F.length(part) <= 3, part.cast("int") <= 255).otherwise(False)),
        "card": lambda: F.when(size.between(13, 19), luhn(_digits(match))).otherwise(False),
        "phone": lambda: size.between(9, 15),
        "iban": lambda: F.when(F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34), mod97(F.replace(match, F.lit(" "), F.lit("")))).otherwise(False),
        "ssn": lambda: ~match.rlike("^(000|666|9)|-00-|-0000$"),
        "tel": lambda: F.lit(True),
    }[kind]()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's own loops use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _most(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0))


def _before(values: Column, total: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """For each value the total of those before it: of whole groups first, then within its own group."""
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / GROUP).cast("int")), lambda g: F.slice(values, g * GROUP + 1, F.lit(GROUP)))

    def within(group: Column, base: Column) -> Column:
        return F.transform(group, lambda _, i: join(base, total(F.slice(group, F.lit(1), i))))

    def filled(gs: Column) -> Column:
        return let(F.transform(gs, total), lambda sums: F.flatten(F.transform(gs, lambda g, k: let(total(F.slice(sums, F.lit(1), k)), lambda base: within(g, base)))))

    return let(groups, filled)


def _located(text: Column, rule: str) -> Column:
    """(m, s, near) of all matches: what matched, where it starts, and up to CONTEXT_CHARS on either side of it."""

    def placed(m: Column, p: Column) -> Column:
        def near(i: Column) -> Column:
            back = F.when(i > 0, F.concat(F.right(F.get(p, i - 1), F.lit(CONTEXT_CHARS)), F.get(m, i - 1))).otherwise("")
            return F.concat_ws(" \n ", F.right(F.concat(back, F.get(p, i)), F.lit(CONTEXT_CHARS)), F.left(F.get(p, i + 1), F.lit(CONTEXT_CHARS)))

        def built(starts: Column) -> Column:
            return F.transform(m, lambda x, i: F.struct(x.alias("m"), (F.get(starts, i) + F.length(F.get(p, i))).alias("s"), near(i).alias("near")))

        sizes = F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x))
        return let(let(sizes, lambda steps: _before(steps, _sum, lambda a, b: a + b)), built)

    return let(F.regexp_extract_all(text, F.lit(rule), F.lit(0)), lambda m: let(F.split(text, rule, -1), lambda p: placed(m, p)))


def _confirmed(kind: str, proposed: Column) -> Column:
    """The proposed spans of a kind that its validator confirms, scored; added kinds by score too."""

    def scored(x: Column) -> Column:
        score = F.lit(PRIOR[kind]) + F.when(x["near"].rlike(f"(?i)\\b(?:{CONTEXT[kind]})"), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["s"].cast("int").alias("start"), (x["s"] + F.length(x["m"])).cast("int").alias("end"), F.least(F.lit(1.0), score).alias("score"))

    spans = F.transform(F.filter(proposed, lambda x: _valid(kind, x["m"])), scored)
    return F.filter(spans, lambda x: x["score"] >= NEEDED) if kind in ADDED else spans


def find_spans(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with the array ``out`` of (kind, start, end, score), kinds in order, then by start."""
    rules = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "tel": LOCAL}
    likely = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){12}", "phone": "\\+[0-9]", "iban": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "ssn": "[0-9]-[0-9]{2}-[0-9]", "tel": "[0-9][ .-][0-9]{4}"}
    kept = df.columns
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    raw = "__tesselon_pii_text"
    found = df.withColumn(raw, F.when(body.rlike("[0-9@]"), body))
    for kind in rules:
        found = found.withColumn(f"__tesselon_has_{kind}", F.coalesce(F.col(raw).rlike(likely[kind]), F.lit(False)))
    none = F.array().cast(f"array<{_SPAN}>")
    parts = [F.when(F.col(f"__tesselon_has_{kind}"), _confirmed(kind, _located(F.col(raw), rule))).otherwise(none) for kind, rule in rules.items()]
    return found.withColumn(out, F.concat(*parts)).select(*[col(c) for c in kept], out)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the counts by base kind, the digest of the base spans, all spans, and the highest score."""
    spans = F.col("pii")
    found = find_spans(df.select(col(key), col(text)), text)
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    counts = [_count(spans, k).alias(f"n_{k}") for k in BASE]
    return found.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), F.array_max(F.transform(spans, lambda x: x["score"])).alias("top_score"))


def _chunks(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / size).cast("int")), lambda k: F.substring(text, k * size + 1, F.lit(size)))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, from its chunks."""

    def part(k: Column) -> Column:
        low = F.greatest(start - k * CHUNK, F.lit(0))
        return F.substring(F.get(chunks, k), low + 1, F.least(end - k * CHUNK, F.lit(CHUNK)) - low)

    ks = F.sequence(F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int"))
    return F.when(end > start, F.array_join(F.transform(ks, part), "")).otherwise("")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def done(xs: Column, ends: Column, chunks: Column) -> Column:
        runs = F.filter(F.transform(xs, lambda x, i: F.struct(F.get(ends, i).alias("at"), x["start"].alias("start"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["at"])
        shown = F.transform(runs, lambda x: F.concat(_cut(chunks, x["at"], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.concat(F.array_join(shown, ""), _cut(chunks, F.array_max(F.transform(xs, lambda x: x["end"])), F.length(text)))

    def with_ends(xs: Column) -> Column:
        ends = let(F.transform(xs, lambda x: x["end"]), lambda e: _before(e, _most, lambda a, b: F.greatest(a, b)))
        pieces = let(_chunks(text, CHUNK * CHUNKS), lambda big: F.flatten(F.transform(big, lambda x: _chunks(x, CHUNK))))
        return let(ends, lambda e: let(pieces, lambda c: done(xs, e, c)))

    return F.when(F.size(spans) > 0, let(ordered, with_ends)).otherwise(text)


def masked(df: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """``df`` with its spans masked in the text; ``chars`` follows the text where that changes."""
    pii = free_name(df, "pii")
    found = find_spans(df, text, pii)
    changed = F.size(col(pii)) > 0
    new = redacted(col(text).cast("string"), col(pii))
    kept = {text: new} | ({chars: F.when(changed, F.length(new).cast("long")).otherwise(col(chars))} if chars else {})
    return found.select(*[kept[c].alias(c) if c in kept else col(c) for c in df.columns])
