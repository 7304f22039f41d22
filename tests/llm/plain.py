"""Plain versions of the corpus operators: no Spark, no numpy tables, one text at a time."""

import hashlib
import io
import math
import re
import wave
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\W\d_]+")


def grams(word, n):
    marked = word if n == 1 else f"^{word}$"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


class Language:
    """Word-first backoff over dictionaries of counts."""

    def __init__(self, rows, often=2):
        words, pieces = defaultdict(Counter), defaultdict(Counter)
        for text, lang in rows:
            if text is not None and lang is not None:
                for w in WORDS.findall(text.lower()):
                    words[w][lang] += 1
                    for n in range(1, 6):
                        for g in grams(w, n):
                            pieces[g][lang] += 1
        self.languages = sorted({x for c in pieces.values() for x in c})
        self.words = self.logs({w: c for w, c in words.items() if sum(c.values()) >= often})
        self.grams = {}
        for n in range(1, 6):
            self.grams |= self.logs({g: c for g, c in pieces.items() if len(g) == n})

    def logs(self, counts):
        total = {x: sum(c[x] for c in counts.values()) + 0.1 * max(1, len(counts)) for x in self.languages}
        out = {}
        for k, c in counts.items():
            row = [math.log((c[x] + 0.1) / total[x]) for x in self.languages]
            out[k] = [v - sum(row) / len(row) for v in row]
        return out

    def evidence(self, word):
        if word in self.words:
            return self.words[word]
        for n in range(5, 0, -1):
            found = [self.grams[g] for g in grams(word, n) if len(g) == n and g in self.grams]
            if found:
                return [sum(v) / len(found) for v in zip(*found)]
        return [0.0] * len(self.languages)

    def predict(self, text):
        words = WORDS.findall((text or "").lower())
        if not any(c.isalpha() for w in words for c in w) or not self.languages:
            return "und", 0.0
        total = [sum(v) / math.sqrt(len(words)) for v in zip(*map(self.evidence, words))]
        e = [math.exp(v - max(total)) for v in total]
        return self.languages[e.index(max(e))], max(e) / sum(e)


def walk(trees, x):
    """Probability by going down one tree after another, node by node."""
    total = trees.base
    for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > limit[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + math.exp(-total))


def media_row(text):
    """n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of a text."""
    raw = (text or "").encode()
    payload = raw + b" " * ((192 - len(raw) % 192) % 192 if raw else 192)
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setparams((1, 1, 8000, len(payload), "NONE", ""))
        w.writeframes(payload)
    x = [b - 128 for b in payload]
    mean = sum(x) / len(x)
    values = [mean, math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)), sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])) / (len(x) - 1)]
    part = len(x) // 8
    values += [math.sqrt(sum(v * v for v in x[k * part : (k + 1) * part]) / part) for k in range(8)]
    media = f.getvalue()
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), values


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def private(text):
    """(start, value) of what a plain search finds: addresses, social security numbers, cards, network addresses, phone numbers."""
    found = []
    for start in range(len(text)):
        if start and text[start - 1].isascii() and text[start - 1].isalnum():
            continue
        rest = text[start : start + 120]
        for pattern in (r"[A-Za-z0-9]+(?:[._+\-][A-Za-z0-9]+)*@[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*\.[A-Za-z]{2,}", r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9A-Za-z-])"):
            if m := re.match(pattern, rest):
                found.append((start, m[0]))
        if m := re.match(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])", rest):
            if m[0][0] != "0" and luhn([int(c) for c in m[0] if c.isdigit()]):
                found.append((start, m[0]))
        if m := re.match(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z.])", rest):
            if all(int(p) < 256 for p in m[0].split(".")):
                found.append((start, m[0]))
    return found


def shape(text):
    return "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in text)


def components(rows, words, percent):
    """{doc_id: (number of shingles, least doc_id that is reachable)} by comparing all pairs."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}
