"""Plain versions of what the operators compute, and awkward rows."""

import random
import re
import zlib
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """doc_id -> smallest linked doc_id, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    above = {i: i for i, _ in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((top(i), top(j)))
                above[y] = x
    return {i: top(i) for i in above}


def crc(doc_id, fold):
    return zlib.crc32(str(doc_id).encode()) % fold


def prose(rng, n, vocabulary=4_000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_copies(seed=1):
    """Groups of copies with edits, a shared passage, tiny and empty texts."""
    rng = random.Random(seed)
    rows, boilerplate = [], prose(rng, 60)
    for g in range(25):
        base = prose(rng, rng.choice([3, 5, 6, 8, 12, 30, 80, 200, 600])).split()
        for _ in range(rng.choice([1, 2, 3, 30 if g % 8 == 0 else 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [f"e{rng.randrange(10**6)}"]
            text = " ".join(copy)
            if rng.random() < 0.2:
                text = boilerplate + "\n" + text
            rows.append((len(rows), text.upper() if rng.random() < 0.1 else text))
    return [*rows, (len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n "), (len(rows) + 3, "One"), (len(rows) + 4, "one")]


def repeated_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(found)
    return len({i + k for i, x in enumerate(found) if n[x] > 1 for k in range(3)})
