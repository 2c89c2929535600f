"""Slow, plain versions of the operators that SQL cannot express."""

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np

from docstrand.llm.op10_quality import fit

BASE, MASK = 0x9E3779B97F4A7C15, 2**64 - 1


class Union:
    def __init__(self, ids):
        self.of = {i: i for i in ids}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def shingles(text):
    w = [x.lower() for x in words(text)]  # bytes.lower: A-Z only
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(p, q):
    return bool(p) and bool(q) and 100 * len(p & q) >= 75 * len(p | q)


# language


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def gram_code(g):
    h = 0
    for n, c in enumerate(g, 1):
        h = (h * BASE + (0 if c == "\0" else ord(c)) + n) & MASK
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & MASK
    return (h ^ h >> 31) >> 16


def grams(text):
    found, word = Counter(), ""
    for c in (text or "").lower() + "\0":
        if unicodedata.category(c)[0] in "LM":
            word += c
            continue
        if word:
            s = "\0" + word + "\0"
            found.update(s[i : i + n] for n in range(1, 4) for i in range(len(s) - n + 1) if s[i : i + n] != "\0")
        word = ""
    return found


def ranked(counts, most):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], gram_code(x[0])))[:most]]


def languages(rows, most=400):
    """{row number: (lang_pred, score)} of rows (doc_id, text, lang)."""
    totals = {}
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and not held_out(doc_id):
            totals.setdefault(lang, Counter()).update(grams(text))
    profiles = {x: {g: r for r, g in enumerate(ranked(c, most))} for x, c in sorted(totals.items())}
    out = {}
    for i, (_, text, _) in enumerate(rows):
        letters = any(unicodedata.category(c)[0] == "L" for c in (text or "").lower())
        top = ranked(grams(text), most) if letters else []
        best = None
        for x, p in profiles.items():
            d = sum(min(abs(p[g] - r), most) if g in p else most for r, g in enumerate(top))
            if top and (best is None or d < best[0]):
                best = (d, x)
        out[i] = (best[1], 1 - best[0] / (most * len(top))) if best else ("und", 0.0)
    return out


# quality


def features(text):
    raw, w = (text or "").encode(), words(text)
    lower = [x.lower() for x in w]
    count = lambda f: sum(map(f, raw))
    letters = count(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
    symbol = {c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-?()|"}
    n, size = max(len(w), 1), max(len(raw), 1)
    same = sum(a == b for a, b in zip(lower, lower[1:]))
    return [
        np.log1p(len(w)), np.sqrt(count(lambda b: 65 <= b <= 90) / max(letters, 1)), np.sqrt(count(symbol.__contains__) / size), np.sqrt(count(lambda b: b == 124) / size), np.sqrt(same / n),
        np.log(max(len(set(lower)), 1)) / np.log(n + 1), np.log1p(letters / n), np.sqrt(count(lambda b: 48 <= b <= 57) / size), np.sqrt(count(lambda b: chr(b) in ".?!") / n),
    ]


def prior(groups):
    """(m, mean) by the method of moments of [(n, bad)]."""
    total, bad, k = sum(n for n, _ in groups), sum(b for _, b in groups), len(groups)
    mean = bad / total
    spread = mean * (1 - mean)
    between = sum(b * b / n for n, b in groups) - mean * bad - spread * (k - 1)
    within = spread * (total - sum(n * n for n, _ in groups) / total - k + 1)
    if within <= 1e-9:
        return 10.0, mean
    return (round(min(max(1 / (between / within) - 1, 1.0), 1000.0), 6) if between > 1e-9 else 1000.0), mean


def quality(rows, labels):
    """[quality] of rows (doc_id, text, source); labels: {doc_id: 0 or 1}."""
    x = np.array([features(t) for _, t, _ in rows])
    known = {(d, t): (labels[d], *f) for (d, t, _), f in zip(rows, x) if d in labels}
    data = np.array(sorted(known.values()), float)
    weights, intercept = fit(data[:, 1:], data[:, 0]) if len(data) else (np.zeros(18), 0.0)
    z = np.clip(intercept + np.column_stack([x, x * x]) @ weights, -8, 8)
    p = np.round(1 / (1 + np.exp(-z)), 6)
    parts = [((s or "").split("/") + [""])[:2] for _, _, s in rows]
    evidence = [float(labels[d]) if d in labels else v for (d, _, _), v in zip(rows, p)]
    hosts, paths = {}, {}
    for (h, q), e in zip(parts, evidence):
        for to, key in ((hosts, h), (paths, (h, q))):
            n, s = to.get(key, (0, 0.0))
            to[key] = n + 1, s + e
    (m_host, mean), (m_path, _) = prior(list(hosts.values())), prior(list(paths.values()))
    mean_of_all = min(max(mean, 1e-6), 1 - 1e-6)
    out = []
    for (h, q), e, v in zip(parts, evidence, p):
        host = (hosts[h][1] + m_host * mean) / (hosts[h][0] + m_host)
        n, s = paths[h, q]
        site = min(max((s - e + m_path * host) / (n - 1 + m_path), 1e-6), 1 - 1e-6)
        logit = np.log(v / (1 - v)) + np.log(site / (1 - site)) - np.log(mean_of_all / (1 - mean_of_all))
        out.append(1 / (1 + np.exp(-logit)))
    return out
