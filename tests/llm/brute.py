"""Plain statements of what the operators compute."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, fold=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if fold else text)


def shingles(w, k=5):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


def components(rows):
    """(doc_id, text) rows with distinct ids to {doc_id: (set size, component)}."""
    sets = {i: set(shingles(words(t, True))) for i, t in rows}
    holders, both = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for h in holders.values():
        both.update((a, b) for k, a in enumerate(h) for b in h[k + 1 :])
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for (a, b), c in both.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(rows, k=35):
    """Sorted (doc_id, words, removed, digest) of all rows."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(b" ".join(w[j : j + k]) for _, w in split for j in range(len(w) - k + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if seen[b" ".join(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def base_rules(text):
    w, c = words(text), Counter()
    c.update(shingles(w) if len(w) >= 5 else [])
    mark = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            mark[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(mark), len(w) < 10 or 100 * sum(mark) > 20 * len(w))


def contamination(docs, items):
    """{(doc_id, item_id): (best similarity, start)}."""
    kept = [(i, words(t, True)) for i, t in items if words(t)]
    own = {i: Counter(shingles(w)) for i, w in kept}
    weight = lambda x: sum(len(w.encode()) for w in x)
    out = {}
    for d, t in docs:
        w = words(t, True)
        for i, item in kept:
            n, best = min(len(item), len(w)), (0.0,)
            for s in range(len(w) - n + 1 if w else 0):
                c = Counter(shingles(w[s : s + n]))
                value = sum(min(c[x], own[i][x]) * weight(x) for x in c) / sum(max(c[x], own[i][x]) * weight(x) for x in {*c, *own[i]})
                if value >= 0.75 - 1e-12 and value > best[0] + 1e-12:
                    best = (value, s)
            if best[0]:
                out[d, i] = best
    return out


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def private(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def damaged(rows):
    """(conv_id, turn, role, text) rows after damage."""
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def repaired(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired hash of one conversation: a uniform-cost search over whole audits."""
    rows = sorted(rows, key=lambda q: (q[1] is not None, q[1] or 0, q[2], q[3]))
    turns, seen, faults = [q[1] for q in rows if q[1] is not None], set(), []
    for _, _, r, x in rows:
        solid = "".join(WORD.findall(x))
        faults.append("b" if not solid else "d" if (r, x) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    initials = [q[2][:1] for q in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, said = heapq.heappop(heap)
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        following = "a" if roles[-1:] == "u" else "u"
        name = {"u": "user", "a": "assistant"}[following]
        heapq.heappush(heap, (cost + 2, audit + "I", i, roles + following, (*said, name + ":")))
        if i < len(rows):
            _, _, r, x = rows[i]
            more = int(faults[i] == "t")
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, said))
            if faults[i] not in ("b", "d"):
                if initials[i] == following or (initials[i] == "s" and not roles):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + initials[i], (*said, f"{r}:{x}")))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + following, (*said, f"{name}:{x}")))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def repairs(rows):
    by = {q[0]: [] for q in rows}
    for q in damaged(rows):
        by[q[0]].append(q)
    return {c: repaired(v) for c, v in by.items()}


def hard_negatives(rows, every=100):
    """Results for (vec_id, label, components) rows with distinct identifiers."""
    rows = [(i, y, [math.floor(256 * c) for c in v]) for i, y, v in rows if None not in (i, y, v) and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, y, v in rows:
        if i % every:
            continue
        told = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in rows if j != i)
        for s, p, _ in [t for t in told if t[2] == y][:5]:
            window = [t for t in told if t[2] != y and 30 * -s <= 100 * -t[0] <= 90 * -s][:10]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(window)]
    return sorted(out)
