"""Small tables with the awkward cases that every operator has a defined result for."""
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, label string, file string"


def edge_docs(spark, extra=()):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    long_text = " ".join(f"word{i % 977} Straße" for i in range(30_000))
    rows = [(1, "Alpha beta gamma delta epsilon zeta", "en", "a"), (1, "Alpha beta gamma delta epsilon zeta", "en", "a"),
            (2, "alpha  beta gamma\tdelta epsilon zeta", "en", "b"), (3, None, None, None), (4, "", "de", "a"), (5, " \n\t", None, "c"),
            (None, "no identity here at all", "fr", "b"), (None, None, None, None), (6, long_text, "de", "a"), (7, "x" * 200_000, None, "b"),
            (8, "!!! ??? ...", "en", None), (9, "one", "en", "c"), (10, "one two", "en", "c"), *extra]
    return spark.createDataFrame([(*r, None, "x", None, "y", "z") for r in rows], SCHEMA)


def jaccard_components(docs, n, percent):
    """Brute force: (doc_id, set size, smallest doc_id reachable)."""
    sets = []
    for _, text in docs:
        w = WORD.findall((text or "").translate(AZ))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (a, _) in enumerate(docs):
        for y, (b, _) in enumerate(docs[:x]):
            if a is not None and b is not None and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common) and find(a) != find(b):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(docs, sets)), key=str)


def near_copies(seed, groups=8):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 200, 500]))]
        for _ in range(rng.choice([1, 5, 40])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                j = rng.randrange(len(t))
                t[j:j + 1] = [rng.choice(vocabulary)] * rng.choice([0, 1, 2]) or t[j:j + 1]
            texts.append(" ".join(t + (passage.split() if rng.random() < 0.3 else [])))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 50))) + " " + passage for _ in range(60)]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]
