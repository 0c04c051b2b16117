"""Brute-force versions of the operators, over Python lists of (doc_id, text)."""
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def word_repeats(docs, window=50):
    """op2: doc_id -> words, removed, digest."""
    words = {d: WORD.findall((t or "").encode()) for d, t in docs}
    first = {}
    for d in sorted(words):
        for s in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][s:s + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < d:
                gone[s:s + window] = [True] * window
        out[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def byte_repeats(docs, window=200):
    """op9: doc_id -> bytes, removed, runs, digest."""
    count = Counter()
    raw = {d: (t or "").encode() for d, t in docs}
    for b in raw.values():
        count.update(b[s:s + window] for s in range(len(b) - window + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if count[b[s:s + window]] > 1:
                gone[s:s + window] = b"\x01" * window
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingle_set(text):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)])


def jaccard_components(docs, percent=90):
    """op4: doc_id -> set size, component."""
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    seen = set()
    for members in by.values():
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}
