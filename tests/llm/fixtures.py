"""A small table of documents with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, node long"


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "of", "É", "a.", "ß"]
    base = [" ".join(r.choices(words, k=r.randint(30, 120))) for _ in range(12)]
    out: list[tuple[int | None, str | None]] = list(enumerate(base))
    passage = " ".join(r.choices(words, k=60))
    for i in range(12, 40):
        kind = i % 7
        w = r.choice(base).split()
        if kind == 0:
            w = r.choice(base).split()
        elif kind == 1:
            w[r.randrange(len(w))] = "edit"
        elif kind == 2:
            w = w[: len(w) // 2] + passage.split() + w[len(w) // 2 :]
        elif kind == 3:
            w = w[: r.randint(1, 6)]
        elif kind == 4:
            w = w + w
        elif kind == 5:
            w = ["same"] * r.randint(1, 90)
        else:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(words))
        out.append((i, (" " if i % 2 else "\n").join(w)))
    out += [(50, None), (51, ""), (52, " \t\n"), (53, "x"), (None, base[0]), (None, None), (3, base[3]), (60, base[5].upper()), (61, "é" * 3000 + " " + base[1]), (62, "a b  c　d  e\r\nf")]
    return out


def table(spark, rows=None):
    """The documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8) for i, t in (texts() if rows is None else rows)], SCHEMA)


def removed_words(rows, k: int = 20):
    """For each row (words, mask of removed words): windows that start earlier by (id, place), ids that are null last."""
    key = lambda i: (i is None, i or 0)
    first: dict[tuple, tuple] = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - k + 1):
            at, window = (key(i), p), tuple(w[p : p + k])
            if window not in first or at < first[window]:
                first[window] = at
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (key(i), p):
                gone[p : p + k] = [True] * k
        out.append((i, w, gone))
    return out


def shingles(text: str | None, n: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[p : p + n]) for p in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, n: int, num: int, den: int) -> dict:
    """Component of each id by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        both = len(a & b)
        if a and b and den * both >= num * (len(a) + len(b) - both):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    smallest = defaultdict(list)
    for i in parent:
        smallest[find(i)].append(i)
    return {i: min(g) for g in smallest.values() for i in g}
