"""Small corpora that hold the awkward cases, and plain restatements of the contracts."""

import random
import re

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, size string, rank int, score string, bucket string, id long, comp long, copies int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def awkward(n=60, seed=1):
    """Rows with nulls in every column, empty, blank and very long texts, ties, copies and a repeated row."""
    rng = random.Random(seed)
    base = prose(rng, 80)
    texts = [None, "", " \t\n", "one", "One TWO", "é ü ñ", base, base, base.upper(), base + " tail", prose(rng, 30_000), "x" * 200, "ab " * 300]
    while len(texts) < n:
        words = base.split() if rng.random() < 0.4 else prose(rng, rng.randrange(1, 120)).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    rows = [(i * 3 % 997, t, rng.choice(["en", None]), rng.choice(["hot", "hot", "b", "c", None]), "clash", 1, None, "b", i, None, 9) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, base, None, None, *[None] * 7), (None, "", "en", "hot", *[None] * 7)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def linked(rows, size, percent):
    """doc_id -> least doc_id reachable, by comparing all pairs."""
    sets = [(d, shingles(t, size)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {d: top(d) for d in up}
