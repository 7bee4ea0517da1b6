"""Plain Python versions of what the operators find, for small inputs."""

import hashlib
import re
from collections import defaultdict

SEPARATED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

SCOPE = 400
PART = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"""(?:https?|s3)://[^\s"'<>]+""", re.A)
KINDS = ["assign", "access", "hex", "part", "endpoint"]


def words(text):
    return SEPARATED.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    same = defaultdict(list)
    for i, t in docs:
        same[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in same.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, sha(text)) for i in ids]
    return out


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near(docs, size=4):
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]) or docs[a][0] == docs[b][0] is not None:
                parent[top(a)] = top(b)
    out = []
    for n, (i, _) in enumerate(docs):
        ids = [docs[m][0] for m in range(len(docs)) if top(m) == top(n) and docs[m][0] is not None]
        first = min(ids, default=None) if sets[n] else i
        out.append((i, len(sets[n]), first, i == first))
    return out


def repeats(docs, size=50):
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - size + 1):
            run = tuple(w[k:k + size])
            if i is not None:
                first[run] = min(first.get(run, i), i)
    out = []
    for i, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone))))
    return out


def secret_rows(docs):
    out = []
    for i, t in docs:
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        near_any = lambda at, others: any(abs(at - b) <= SCOPE for b in others)
        ids = [b for b, k, _ in base if k == 1]
        parts = [(m.start(), 3, m.end()) for m in PART.finditer(t) if near_any(m.start(), ids)]
        strong = [b for b, k, _ in base + parts if k != 1]
        ends = [
            (m.start(), 4, m.end()) for m in ENDPOINT.finditer(t)
            if near_any(m.start(), ids) and near_any(m.start(), strong)
        ]
        joined = lambda spans: ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in sorted(spans))
        counts = [sum(k == n for _, k, _ in base) for n in range(3)]
        out.append((i, *counts, sha(joined(base)), joined(base + parts + ends)))
    return out
