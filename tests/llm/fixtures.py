"""A small corpus with copies, near copies, shared passages, odd rows and clashing columns."""

import random

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, keys string, digest string, n int, id string, th string, d double"


def words(text):
    return (text or "").encode().split()


def corpus(seed=7, size=60):
    """(doc_id, text) pairs."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioudhlnrst") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs, passage = [], prose(60)
    for i in range(size):
        lines = [prose(r.randrange(5, 40)) + "." for _ in range(r.randrange(1, 7))]
        if i % 5 == 0:
            lines.insert(r.randrange(len(lines) + 1), passage)
        if i % 3 == 0:
            lines.append(f"Licensed under the terms of version {i}.")
        docs.append((i * 3, "\n".join(lines)))
    longest = max(docs, key=lambda d: len(d[1]))[1]
    for i in range(12):  # near copies of one document, exact copies of another
        base = longest.split(" ")
        base[r.randrange(len(base))] = f"edit{i}"
        docs.append((1000 + i, " ".join(base)))
        docs.append((2000 + i, docs[7][1]))
    docs += [(3000, None), (3001, ""), (3002, "   \n\t "), (3003, "one"), (3004, "One"), (3005, "a b c d"), (3006, "a b c d e"), (None, docs[0][1]), (None, None)]
    docs += [docs[9], docs[9], (3007, "É çà ñ — ’quoted’   end"), (3008, " ".join(vocabulary) * 20)]
    r.shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "g", 2, "x", "y", 0.5) for i, t in docs], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
