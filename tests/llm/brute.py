"""Plain versions of the operators, by definition, for small inputs."""
import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

SEPARATORS = r"[\x20\x09-\x0D]+"


def words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in re.split(SEPARATORS, lower) if w]


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def groups(ids, linked):
    """Smallest id reachable, for each position; linked: pairs of positions."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in linked:
        parent[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(ids))]


def jaccard_components(rows):
    """{position: (n_shingles, component)}; rows: (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    linked = [(i, j) for i, j in combinations(range(len(rows)), 2)
              if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return [(len(s), c) for s, c in zip(sets, groups([d for d, _ in rows], linked))]


def substring_dedup(rows, length=200):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]."""
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s:s + length], []).append((d, s))
    covered = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                covered[d][s:s + length] = b"\x01" * length
    out = []
    for (doc, _), t, c in zip(rows, texts, covered):
        kept = bytes(b for b, x in zip(t, c) if not x)
        out.append((doc, len(t), sum(c), len(re.findall(rb"\x01+", bytes(c))), hashlib.sha256(kept).hexdigest()))
    return out


def base_spans(text):
    """[(start, kind, end)] of the base patterns of the secret scan."""
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def letter_grams(text):
    """For each word of letters: (context code, symbol) of each symbol and of the word's end, six symbols back at most."""
    symbols = [b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 27 + b % 37 if b >= 128 else 0 for b in (text or "").encode()]
    out, word = [], []
    for s in [*symbols, 0]:
        if s:
            word.append(s)
        elif word:
            out.append([(sum(x << 6 * k for k, x in enumerate(reversed(word[max(0, i - 6):i]))), s) for i, s in enumerate([*word, 0])])
            word = []
    return out


class KneserNey:
    """Interpolated Kneser-Ney of two classes with shared lower orders; ratio[(context, symbol or None for others)]."""

    def __init__(self, rows):
        count = [Counter(), Counter()]
        for text, toxic in rows:
            count[toxic].update(g for word in letter_grams(text) for g in word)
        grams = set(count[0]) | set(count[1])
        whole = {c << 6 | s for c, s in grams}
        n = [None] * 7
        for order in range(1, 7):
            longer = {g % (1 << 6 * (order + 1)) for g in whole}
            n[order] = Counter(g % (1 << 6 * order) for g in longer)
        by_context = [defaultdict(list) for _ in n]
        for order in range(1, 7):
            for g, k in n[order].items():
                by_context[order][g >> 6].append(k)

        def shared(g, order):
            if order == 0:
                return 1 / 64
            g %= 1 << 6 * order
            seen = by_context[order][g >> 6]
            return max(n[order][g] - 0.75, 0) / sum(seen) + 0.75 * len(seen) / sum(seen) * shared(g, order - 1)

        def less(c):
            of = [0, *(max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4))]
            share = of[1] / (of[1] + 2 * of[2])
            by = [0, *(min(max(k - (k + 1) * share * of[k + 1] / of[k], 0.1), k) for k in (1, 2, 3))]
            return lambda v: by[min(v, 3)]
        take = [less(c) for c in count]
        symbols = defaultdict(set)
        for c, s in grams:
            symbols[c].add(s)
        self.ratio = {}
        for c, seen in symbols.items():
            total = [sum(k[c, s] for s in seen) for k in count]
            back = [sum(take[x](count[x][c, s]) for s in seen) / total[x] if total[x] else 1 for x in (0, 1)]
            self.ratio[c, None] = math.log(back[1]) - math.log(back[0])
            for s in seen:
                p = [(count[x][c, s] - take[x](count[x][c, s])) / max(1, total[x]) + back[x] * shared(c << 6 | s, 6) for x in (0, 1)]
                self.ratio[c, s] = math.log(p[1]) - math.log(p[0])

    def features(self, text):
        words = [[self.ratio.get(g, self.ratio.get((g[0], None), 0.0)) for g in word] for word in letter_grams(text)]
        best = sorted((max(0.0, sum(w)) for w in words), reverse=True)[:3]
        return sum(map(sum, words)) / max(1, sum(map(len, words))), (best or [0.0])[0], sum(best) / 3
