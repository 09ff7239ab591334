"""Plain Python versions of the operators, for small tables."""
import hashlib
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def decontaminate(docs, items, size=8):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = norm(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2))
    return out


def dedup_lines(docs, min_docs=10):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    n = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def water_fill(sizes, weights=(5, 2, 1), top=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in done]
        if not rest:
            return done
        left, share = total - sum(done.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / share > top * sizes[s]]
        if not over:
            return done | {s: left * w[s] / share for s in rest}
        done |= {s: top * sizes[s] for s in over}
