"""Plain single-machine versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def quality_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {p for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def unigram(docs):
    """held_out, n_tokens, n_known and base_score by doc_id, and the number of training tokens."""
    tokens = {i: (t or "").encode().translate(LOWER).split() + [None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    total, kinds = sum(counts.values()), len(counts)
    return {i: (held[i], len(own), sum(counts[w] > 0 for w in own), sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own))
            for i, own in tokens.items()}, total


def linked_vectors(rows, closeness):
    """n_links and component by id of usable vectors."""
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    linked = v @ v.T >= closeness
    np.fill_diagonal(linked, False)
    groups = Groups()
    for i in ids:
        groups.find(i)
    for a, b in zip(*np.nonzero(linked)):
        groups.join(ids[a], ids[b])
    return {i: (int(linked[k].sum()), groups.find(i)) for k, i in enumerate(ids)}


def without_repeated_strings(docs, length=200):
    """n_bytes, n_removed, n_spans and what is left by doc_id."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[p : p + length] for _, t in raw for p in range(len(t) - length + 1))
    out = {}
    for i, t in raw:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p + 1 : p + 1 + length] = True
        left = np.frombuffer(t, np.uint8)[~gone[1:-1]].tobytes()
        out[i] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), left)
    return out


def _similar(sets, percent):
    """Pairs of keys of different sets whose Jaccard similarity is percent in a hundred or more."""
    by_part = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by_part[x].append(k)
    common = Counter((a, b) for own in by_part.values() for i, a in enumerate(own) for b in own[i + 1 :])
    return [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]


def near_documents(docs, width, percent=80):
    """n_shingles and component by doc_id."""
    sets = {}
    for i, t in docs:
        words = (t or "").encode().translate(LOWER).split()
        k = min(width, len(words))
        sets[i] = frozenset(zip(*[words[x:] for x in range(k)])) if k else frozenset()
    groups = Groups()
    for i in sets:
        groups.find(i)
    for a, b in _similar(sets, percent):
        groups.join(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def line_set(line, width):
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def line_groups(docs, percent=80):
    """The texts by doc_id less lines that repeat another; what stays is each group's first by (doc_id, number).

    Lines below 100 characters are compared by shingles of 4, lines of 80 or more by shingles of 8.
    """
    places = defaultdict(list)
    for i, t in docs:
        for n, x in enumerate((t or "").split("\n")):
            if WORD.search(x):
                places[x].append((i, n))
    groups = Groups()
    for x in places:
        groups.find(x)
    for width, own in ((4, [x for x in places if len(x) < 100]), (8, [x for x in places if len(x) >= 80])):
        for a, b in _similar({x: line_set(x, width) for x in own}, percent):
            groups.join(a, b)
    members = defaultdict(list)
    for x, own in places.items():
        members[groups.find(x)] += own
    gone = {p for own in members.values() for p in sorted(own)[1:]}
    return {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs}, gone


SECRETS = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), (re.compile(r"[0-9a-f]+"), 0, 24),
)


def base_secrets(text):
    """(start, kind, end) of the fixed patterns."""
    return sorted((m.start(), kind, m.end()) for kind, (pattern, group, least) in enumerate(SECRETS)
                  for m in pattern.finditer(text or "") if len(m[group]) >= least)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
