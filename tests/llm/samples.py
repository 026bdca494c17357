"""Chat messages with awkward rows, and plain versions of what the operators compute."""

import random
import re

from pyspark.sql import types as T

# Columns beside the two that operators read; some carry names that operators use inside.
SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("conversation_id", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("pos", T.IntegerType()), T.StructField("word", T.StringType()),
    T.StructField("found", T.StringType()), T.StructField("base", T.StringType()),
    T.StructField("bucket", T.LongType()), T.StructField("length", T.LongType())])

DISHES = ("burger fries lettuce tomato onion cheese sauce grill plate menu table order kitchen server lunch dinner "
          "delivery pickup location payment card cash total discount drink water coffee lemon pepper salt").split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(DISHES) + str(rng.randrange(40)) for _ in range(n))


def messages(spark, contents):
    """One message per (id, content)."""
    rows = [(i, "c1", "user", t, 1, "w", "f", "b", 2, 3) for i, t in contents]
    return spark.createDataFrame(rows, SCHEMA)


LONG = prose(1, 4_000)
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, LONG), (6, prose(2, 60)), (6, prose(2, 60)),
           (None, prose(2, 60)), (7, prose(2, 59) + " changed"), (8, "¿Qué? – 你好 🙂 ﬁ"), (9, None), (9, None)]


def words(text, pattern):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(pattern, low)


def shingles(text, width):
    w = words(text, "[^\x20\x09-\x0D]+")
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def groups(contents, width, percent=80):
    """Component id and set size by plain comparison of all pairs of (id, content)."""
    sets = [shingles(t, width) for _, t in contents]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[top(i)] = top(j)
    out = []
    for i, (key, _) in enumerate(contents):
        ids = [k for j, (k, _) in enumerate(contents) if top(j) == top(i) and k is not None]
        out.append((key, len(sets[i]), min(ids) if ids else None))
    return out


def hits(contents, questions, window):
    """Words, hit words and questions per message, by plain comparison of all windows."""
    pattern = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    known = {}
    for key, text in questions:
        w = words(text, pattern)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[s:s + n]), set()).add(key)
    out = []
    for key, text in contents:
        w, hit, items = words(text, pattern), set(), set()
        for n in {len(k) for k in known}:
            for s in range(len(w) - n + 1):
                if (here := tuple(w[s:s + n])) in known:
                    hit.update(range(s, s + n))
                    items |= known[here]
        out.append((key, len(w), len(hit), sorted(str(i) for i in items if i is not None)))
    return out
