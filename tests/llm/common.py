"""Plain versions of what the operators share."""

import random


def groups(nodes, edges):
    """Smallest node that each node reaches."""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def prose(seed, n, words=400):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 8))) for _ in range(words)]
    return " ".join(r.choice(known) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(k, t, lang, source, len(t or "")) for k, t in enumerate(texts)], DOCS)
