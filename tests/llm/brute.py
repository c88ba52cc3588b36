"""Plain Python versions of what the operators have to return."""

import hashlib
import re

import xxhash

SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def lower(text):
    return (text or "").translate(LOWER)


def licenses(text):
    words = ALNUM.findall(lower(text))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    found = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def quality(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    from collections import Counter

    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    n_dup = len(lines) - len(set(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), n_dup, len(covered)


def secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    out.sort()
    spans = ",".join(f"{k}:{s}:{e}" for s, _, e, k in out)
    n = lambda kind: sum(k == kind for *_, k in out)
    return n("assign"), n("access"), n("hex"), hashlib.sha256(spans.encode()).hexdigest(), [f"{k}:{s}:{e}" for s, _, e, k in out]


def fingerprint(text, shingle=3):
    words = SPACE.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, radius=2):
    """Smallest id reachable for each row."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            best[r] = min(d, best.get(r, d))
    return [best.get(find(i)) for i in range(len(fps))]


def contamination(text, items, window=13):
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        q = ALNUM.findall(lower(t))
        for s in range(max(1, len(q) - window + 1) if q else 0):
            w = q[s : s + window]
            for i in range(len(words) - len(w) + 1):
                if words[i] == w[0] and words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add("null" if item is None else str(item))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(words)


def url(u):
    u = u or ""
    if "://" not in u:
        return "", "", None, "allow"
    rest = u.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    fit = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    best = max(fit, key=len, default=None)
    return host, path, best, rules[best] if best else None
