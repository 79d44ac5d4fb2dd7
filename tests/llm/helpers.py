"""Awkward documents and vectors that every operator must take, and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORD.findall(low(t or ""))


def lexicon(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(["an", "er", "on", "th", "ré", "ü", "st", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, n, known):
    return " ".join(known[min(int(rng.paretovariate(0.7)) - 1, len(known) - 1)] for _ in range(n))


def documents(n=60, seed=1):
    """Prose with copies, near copies, shared lines; and nulls, empties, ties, long and odd texts."""
    rng, known = random.Random(seed), lexicon()
    rows = []
    for i in range(n):
        text = "\n".join(prose(rng, rng.randint(3, 30), known) for _ in range(rng.randint(1, 6)))
        rows.append([i, text, "en", f"src{i % 4}"])
    for i in range(0, 20, 2):
        parts = rows[i][1].split(" ")
        parts[len(parts) // 2] = "changed"
        rows.append([n + i, " ".join(parts), "en", "src0"])
        rows.append([n + i + 1, rows[i][1], "fr", None])
    odd = ["", None, "\n\n \t\n", "a", "A a\na A", "x" * 5000, " ".join(["long"] * 3000), "naïve ÀÉ\u00a0x\u3000y", "don't 123abc!!  \n\n  tail ", "\U0001f525\U0001f525 emoji", "\x00\x1f odd"]
    rows += [[1000 + i, t, None, "odd"] for i, t in enumerate(odd)]
    rows += [[None, "an orphan of no id\nand more", "en", "src1"], [5, rows[5][1], "en", "src1"]]
    rng.shuffle(rows)
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in rows]


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
