"""Plain versions of the query contracts, to hold the queries against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op3(docs: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple]:
    words = {d: WORD.findall(t or "") for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def op4(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def op8(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[int, tuple]:
    def words(t):
        return BENCH_WORD.findall((t or "").translate(LOWER))

    phrases: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 7) if w else 0):
            phrases.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    sizes = sorted({len(p) for p in phrases})
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[p]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def op9(text: str | None) -> tuple:
    text = text or ""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    spans = {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}
    base = ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])
    return (*(len(spans[k]) for k in kinds), sha(base), base)


def op10(docs: list[tuple[int, str | None]], size: int = 4, share: int = 85) -> dict[int, tuple]:
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    held: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(d)
    pairs: Counter = Counter()
    for ds in held.values():
        ds = sorted(set(ds))
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                pairs[a, b] += 1
    for (a, b), n in pairs.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}
