"""Small tables with the awkward cases, and plain versions of the operators."""

import hashlib
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=60, seed=3):
    """Near copies, exact copies, shared passages, repeats, nulls, odd spaces, many bytes a letter."""
    r = random.Random(seed)
    words = [w for w in "the of and river stone éclair naïve über zwölf cañón 東京 data Model layer token bright green window seven lantern harbour copper".split()]
    sentence = lambda k: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(k))
    passage, base = sentence(70), sentence(120)
    out = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            t = sentence(r.randrange(3, 150))
        elif kind == 1:
            w = base.split()
            w[r.randrange(len(w))] = f"edit{i}"
            t = " ".join(w)
        elif kind == 2:
            t = sentence(30) + "\n" + passage + "\n" + sentence(20)
        elif kind == 3:
            t = base
        elif kind == 4:
            t = (sentence(8) + "\n") * r.randrange(1, 9)
        elif kind == 5:
            t = "x" * r.randrange(0, 200) + " " + "ab" * r.randrange(60)
        elif kind == 6:
            t = base.upper() + "\t\x0b  " + sentence(2) if i % 16 == 6 else passage[: r.randrange(len(passage))]
        else:
            t = [None, "", " \t\n", "one two", "One TWO", "a b c d e", "é", sentence(2500)][(i // 8) % 8]
        out.append(t)
    return out


def documents(spark, rows=None, parts=3):
    """doc_ids with gaps, in no order."""
    rows = texts() if rows is None else rows
    r = random.Random(5)
    made = [(7 * i + 3, t, "en", None if i % 9 == 4 else f"src{r.choice([0, 0, 0, 1, 2, 10])}", None if t is None else len(t)) for i, t in enumerate(rows)]
    r.shuffle(made)
    return spark.createDataFrame(made, DOCS).repartition(parts)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def components(rows, percent=75):
    """doc_id -> (set size, least id of the component), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def passages(rows, size=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of the rest, rest)."""
    first = {}
    data = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in data:
        for p in range(len(b) - size + 1):
            first.setdefault(b[p : p + size], i)
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest)
    return out
