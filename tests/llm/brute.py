"""Plain Python versions of the operators, by definition and without any of their methods."""
import hashlib
import re
import zlib
from collections import Counter
from math import log10

UPPER = {i: i + 32 for i in range(65, 91)}
PRINTED = re.compile(r"[^\x20\x09-\x0D]+")
ALPHANUMERIC = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate(UPPER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminate(docs, items, window=10):
    windows = {}
    for i in items:
        w = ALPHANUMERIC.findall(lower(i["text"]))
        n = min(window, len(w))
        for at in range(len(w) - n + 1) if n and i["item_id"] is not None else ():
            windows.setdefault(tuple(w[at:at + n]), set()).add(str(i["item_id"]))
    sizes = {len(w) for w in windows}
    for d in docs:
        w, hit, found = ALPHANUMERIC.findall(lower(d["text"])), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if tuple(w[at:at + n]) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[tuple(w[at:at + n])]
        yield d["doc_id"], len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def shingles(text, size=4):
    w = PRINTED.findall(lower(text))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def ngram_components(docs, size=4, percent=85):
    sets = [shingles(d["text"], size) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        if d["doc_id"] is not None:
            r = find(i)
            least[r] = min(least.get(r, d["doc_id"]), d["doc_id"])
    for i, d in enumerate(docs):
        yield d["doc_id"], len(sets[i]), least.get(find(i)) if sets[i] else d["doc_id"]


def base_scores(docs):
    tokens = [[*PRINTED.findall(lower(d["text"])), None] for d in docs]
    held = [zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 10 == 0 for d in docs]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    for d, t, h in zip(docs, tokens, held):
        yield d["doc_id"], h, len(t), sum(count[w] > 0 for w in t), n, sum(log10((count[w] + .1) / (n + .1 * (v + 1))) for w in t)


def edits(docs):
    rows = sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0), reverse=True)
    for d, after in zip(rows, rows[1:] + rows[:1]):
        t, f = d["text"] or "", after["text"] or ""
        n = len(t) // 3
        yield d["doc_id"], len(t), sha(t[:len(t) - n] + f[:n])


def repeated_bytes(docs, length=100):
    seen = set()
    for d in sorted(docs, key=lambda d: (d["doc_id"] is None, d["doc_id"] or 0)):
        b = (d["text"] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(b[i:i + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield d["doc_id"], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(docs):
    for d in docs:
        t = d["text"] or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(s[2] for s in spans)
        yield d["doc_id"], n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(UPPER)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def back_off_scores(train, texts, least=2, cut=0.75):
    """Log-10 probability of each text by absolute discounting with back-off, over n-grams of ``least`` sightings."""
    tokens = lambda t: [*PRINTED.findall(lower(t or "")), None]
    seen = [Counter(tuple(w[i:i + k]) for t in train for w in [tokens(t)] for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
    total, once, twice = sum(seen[0].values()), *(sum(n == k for n in seen[0].values()) for k in (1, 2))
    off = once / (once + 2 * twice) if once and twice else 0.5
    kept = [{g: n for g, n in c.items() if n >= least} for c in seen[1:]]

    def p(gram):
        if len(gram) == 1:
            n = seen[0].get(gram, 0)
            return (n - off if n else off * len(seen[0])) / total
        if gram in kept[len(gram) - 2]:
            return (seen[len(gram) - 1][gram] - cut) / seen[len(gram) - 2][gram[:-1]]
        after = [g for g in kept[len(gram) - 2] if g[:-1] == gram[:-1]]
        left = max(1 - sum(map(p, after)), 1e-9) / max(1 - sum(p(g[1:]) for g in after), 1e-9)
        return max(left, 1e-9) * p(gram[1:])

    return [sum(log10(p(tuple(w[max(0, i - 2):i + 1]))) for i in range(len(w))) for w in map(tokens, texts)]
