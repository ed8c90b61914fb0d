"""Small document tables with every odd case, and plain versions of shared rules."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, score string, owner string, part string, node string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '.', ',', 'é'])}" for _ in range(n))


def texts(seed=0, n=60):
    """(doc_id, text): prose, copies, near copies, shared passages, nulls, empties, odd spaces, one long text."""
    rng = random.Random(seed)
    passage = prose(rng, 55)
    base = [prose(rng, rng.randrange(30, 160)) for _ in range(n)]
    out = []
    for i, t in enumerate(base):
        words = t.split(" ")
        if i % 7 == 1:
            t = base[i - 1]
        elif i % 7 == 2:
            words = base[i - 2].split(" ")
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(50)}"
            t = " ".join(words)
        elif i % 7 == 3:
            t = t + "\n" + passage.upper() + "\t" + passage
        elif i % 7 == 4:
            t = passage + "  " + t + " \n\n" + t[:40]
        out.append((i * 3, t))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "ONE TWO"), (1005, "one two three four"), (1006, prose(rng, 30_000)), (1007, "\x0b\x1c  x")]
    return out


def documents(spark, rows=None, repeat=True):
    rows = texts() if rows is None else rows
    rows = rows + ([rows[0], (None, rows[4][1]), (None, None)] if repeat and rows else [])
    full = [(d, t, "en", f"src{(d or 0) % 3}" if d != 9 else None, len(t or ""), "x", "y", "z", "p", "q") for d, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def key(x):
    return (x[0] is None, x[0] or 0, *map(str, x[1:]))
