"""A small corpus with odd rows, and plain versions of what the operators must return for it."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, t long, key string, size int, n int, row int, x double, _id long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def make(seed=5, n=60):
    """(doc_id, text, source) rows: copies, near copies, shared passages, repeated lines, a long text, nulls, repeated ids and rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioumnrstélkß") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    line = " ".join(rng.choice(vocab) for _ in range(12))
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        if i % 7 == 0:
            lines.insert(rng.randrange(len(lines)), passage)
        if i % 5 == 0:
            lines.append(line if i % 2 else line.replace(line.split()[3], "changed"))
        rows.append((i, "\n".join(lines), f"s{i % 4}" if i % 9 else None))
    for i in range(0, n, 6):
        w = rows[i][1].split(" ")
        w[rng.randrange(len(w))] = "Edited"
        rows.append((n + i, " ".join(w) if i % 4 else rows[i][1], "s0"))
    rows += [(900, None, "s1"), (901, "", "s1"), (902, " \n\t ", None), (None, rows[0][1], "s2"), (None, None, None), (3, rows[3][1], "s3"), (3, rows[3][1], "s3"), (3, "another text of the same id " + passage, "s3")]
    rows += [(950, "Ab ab AB", "s0"), (951, "ab AB ab", "s0"), (952, "one", "s0"), (953, "one", "s0")]
    rows.append((960, "x" * 3000 + " " + " ".join(rng.choice(vocab) for _ in range(9000)) + "\n" + passage, "s0"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "k", 3, 4, 5, 0.5, 6) for i, t, s in rows], SCHEMA).repartition(3)


def components(rows, size=5, percent=75):
    """One (doc_id, shingles, component) for each row."""
    return sorted(((i, n, low) for (i, _, _), (_, n, low) in zip(rows, groups(rows, size, percent))), key=str)


def groups(rows, size=5, percent=75):
    """(component key, shingles, smallest id in the component) of each row, in order; a row without shingles is alone."""
    sets = []
    for _, t, _ in rows:
        w = [a.translate(LOWER) for a in words(t)]
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return [(find(a), len(sets[a]), low.get(find(a)) if sets[a] else i) for a, (i, _, _) in enumerate(rows)]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def word_windows(rows, width=13):
    last = 2**63 - 1
    first = {}
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, t, _ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (last if i is None else i):
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(a for a, g in zip(w, gone) if not g).encode())))
    return sorted(out, key=str)


def byte_windows(rows, width=200):
    seen = Counter()
    texts = [(t or "").encode() for _, t, _ in rows]
    for b in texts:
        seen.update(b[k : k + width] for k in range(len(b) - width + 1))
    out = []
    for (i, _, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(a for a, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def near_lines(rows, percent=75):
    """(doc_id, lines, removed line numbers) for each row; ``rows`` with distinct ids."""
    at = sorted(((i, k), frozenset(words(line))) for i, t, _ in rows for k, line in enumerate((t or "").split("\n")) if words(line))
    gone = {p for a, (p, w) in enumerate(at) if any(100 * len(w & v) >= percent * len(w | v) for _, v in at[:a])}
    return sorted((i, 0 if t is None else len(t.split("\n")), ",".join(str(k) for k in sorted(k for j, k in gone if j == i))) for i, t, _ in rows)
