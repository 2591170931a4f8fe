"""Plain-Python versions of the corpus operators, for small tables."""

import re
from bisect import bisect_left
from math import exp

from xxhash import xxh64_intdigest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# --- decontamination -----------------------------------------------------------------------------------


def template(text, units):
    """(value, kind) per template word; kind 0 plain, 1 number, 2 unit, 3 name."""
    out = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        m = re.search(rb"[0-9A-Za-z\x80-\xff](?:.*[0-9A-Za-z\x80-\xff])?", w, re.S)
        if not m:
            continue
        value = m[0].lower()
        if re.fullmatch(rb"[0-9][0-9.,:/-]*", value):
            kind = 1
        elif out and out[-1][1] == 1 and value.decode("utf-8", "replace") in units:
            kind = 2
        else:
            kind = 3 if b"A" <= m[0][:1] <= b"Z" else 0
        out.append((value, kind))
    return out


def one_to_one(pairs):
    """pairs of (kind, item value, document value)."""
    for kind in (1, 2, 3):
        seen = {(a, b) for k, a, b in pairs if k == kind}
        if len({a for a, _ in seen}) < len(seen) or len({b for _, b in seen}) < len(seen):
            return False
    return True


def contaminated(docs, items, units, window=13, shortest=5):
    """[(doc row number, item number, matched_words, item_words, exact)] by looking at every pair of windows."""
    def reading(word, keep_names):
        value, kind = word
        return kind if kind in ((1, 2) if keep_names else (1, 2, 3)) else value

    out = []
    split = [template(t, units) for t in docs]
    for m, item in enumerate(items):
        t = template(item, units)
        n = min(window, len(t))
        if len(t) < shortest:
            continue
        for d, doc in enumerate(split):
            shifts = {}
            for keep in (False, True):
                for q in range(len(t) - n + 1):
                    w = [reading(x, keep) for x in t[q : q + n]]
                    if sum(isinstance(x, int) for x in w) > n / 2:
                        continue
                    for p in range(len(doc) - n + 1):
                        if reading(doc[p], keep) == w[0] and [reading(x, keep) for x in doc[p : p + n]] == w:
                            shifts.setdefault(p - q, set()).add(q)
            best = (0, False)
            for shift, starts in shifts.items():
                pairs = lambda at: [(t[x][1], t[x][0], doc[x + shift][0]) for x in at]
                spans = [range(q, q + n) for q in starts]
                if not one_to_one(pairs({x for s in spans for x in s})):
                    spans = [s for s in spans if one_to_one(pairs(s))]
                at = {x for s in spans for x in s}
                if at:
                    best = max(best, (len(at), all(a == b for _, a, b in pairs(at))))
            if best[0]:
                out.append((d, m, best[0], len(t), best[1]))
    return out


# --- the other stages of the pipeline ------------------------------------------------------------------


def additive_score(model, x):
    """A sum of looked-up table entries, squashed."""
    z = model.intercept + sum(table[bisect_left(list(edge), v)] for edge, table, v in zip(model.edges, model.single, x, strict=True))
    for i, j, table in model.pairs:
        z += table[bisect_left(list(model.coarse[i]), x[i])][bisect_left(list(model.coarse[j]), x[j])]
    return 1 / (1 + exp(-z))


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def first_of_groups(docs):
    """docs {id: text} -> ids that are the smallest of their linked group."""
    fps = {}
    for i in sorted(docs):
        fps.setdefault(fingerprint(docs[i]), i)
    seen, keep = set(), set()
    for f in sorted(fps, key=fps.get):
        if f not in seen:
            keep.add(fps[f])
            todo = [f]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [y for y in fps if (x ^ y).bit_count() <= 3]
    return keep


def without_repeats(docs, window=50):
    """docs {id: text} -> {id: text without the words of windows that a smaller id has}; untouched texts stay."""
    least = {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - window + 1):
            least.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in docs.items():
        w = words(t)
        gone = {x for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < i for x in range(k, k + window)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    return out


def shares(size, weights=(1, 2, 3), repeats=3):
    """size {source: words} -> {source: target}: shared by weight, capped, the excess shared again."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    done, total = {}, sum(size.values())
    while len(done) < len(order):
        free = [s for s in order if s not in done]
        level = (total - sum(done.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > repeats * size[s]]
        done |= {s: float(repeats * size[s]) for s in over} if over else {s: level * weight[s] for s in free}
    return done


# --- learned scores --------------------------------------------------------------------------------------


def quality_features(text):
    """The quality features of a text (bytes), by their names, one after another."""
    from collections import Counter
    from math import log1p

    w = re.findall(rb"[^\x20\x09-\x0D]+", text)
    if not w:
        return {}
    n, chars, many = len(w), sum(map(len, w)), Counter(w)
    count = lambda chars: sum(text.count(bytes([c])) for c in chars)
    lines = [tuple(x) for line in text.split(b"\n") if (x := re.findall(rb"[^\x20\x09-\x0D]+", line))]
    upper = bytes(range(65, 91))
    return {
        "log_words": log1p(n), "mean_word": chars / n, "longest_word": max(map(len, w)), "symbols": count(rb"#*$%&|<>@^~{}[]" + b"\\") / n, "uppers": count(upper) / chars, "digits": count(b"0123456789") / n,
        "stops": count(b".?,;:") / n, "shouts": count(b"!") / n, "bars": count(b"|\t") / n, "short_words": sum(len(x) <= 3 for x in w) / n, "non_ascii": sum(b >= 128 for b in text) / chars,
        "lines": text.count(b"\n") / n, "repeats": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, "variety": len(many) / n, "top_word": max(many.values()) / n,
        "dup_lines": (len(lines) - len(set(lines))) / len(lines), "urls": count(b"/@_=") / n, "letters": count(upper + upper.lower()) / chars,
    }


def toxicity_score(model, text, word_hash, length, stride, piece, trigrams):
    """The network's score of a text (bytes): every window step by step, the highest one squashed."""
    import numpy as np

    def mixed(x):
        m = (1 << 64) - 1
        x = (x + 0x9E3779B97F4A7C15) & m
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    p, w = model.p, []
    for x in re.findall(rb"[^\x20\x09-\x0D]+", text.lower()):
        if m := re.search(rb"[0-9a-z\x80-\xff](?:.*[0-9a-z\x80-\xff])?", x, re.S):
            w += [m[0][k : k + piece] for k in range(0, len(m[0]), piece)]
    known = {int(h): k + 1 for k, h in enumerate(model.vocabulary)}

    def vector(x):
        marked = b"\x01" + x + b"\x02"
        tri = [mixed(marked[k] | marked[k + 1] << 8 | marked[k + 2] << 16) % trigrams for k in range(len(x))]
        return np.concatenate([p["word"][known.get(word_hash(x), 0)], p["char"][tri].mean(0)])

    squash = lambda v: 1 / (1 + np.exp(-v))
    size = p["u"].shape[1]
    best = -np.inf
    for first in sorted({min(k, max(len(w) - length, 0)) for k in range(0, max(len(w) - length, 0) + stride, stride)}):
        x = [vector(v) for v in w[first : first + length]]
        states = np.zeros((len(x), 2 * size))
        for d, order in ((0, range(len(x))), (1, range(len(x) - 1, -1, -1))):
            h = np.zeros(size)
            for t in order:
                a, s = x[t] @ p["w"][d] + p["b"][d], h @ p["u"][d]
                z, r = squash(a[:size] + s[:size]), squash(a[size : 2 * size] + s[size : 2 * size])
                h = z * h + (1 - z) * np.tanh(a[2 * size :] + r * s[2 * size :])
                states[t, d * size : (d + 1) * size] = h
        e = np.exp(np.tanh(states @ p["att"] + p["att_b"]) @ p["att_v"])
        best = max(best, float((e / max(e.sum(), 1e-9)) @ states @ p["out"] + p["out_b"][0]))
    return squash(model.slope * best + model.offset)
