"""Direct versions of the text operators over small Python lists."""

from __future__ import annotations

import collections
import math
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_bag(text, n=5):
    w = words(text)
    return collections.Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else None


def near_classes(docs, least=0.8):
    """Smallest id of the component of each (id, text)."""
    bags = {i: shingle_bag(x) for i, x in docs}
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b and bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if both >= least * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


class Ppm:
    """The same model with the trie as a dictionary."""

    def __init__(self, texts, order):
        self.order, self.trie = order, collections.defaultdict(collections.Counter)
        for x in texts:
            for context, byte in self.bytes_of(x):
                for k in range(order + 1):
                    self.trie[context[order - k :]][byte] += 1

    def bytes_of(self, text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        coded = b" " * self.order + b"".join(w.encode() + b" " for w in words(low)) + b"\n"
        return [(coded[j - self.order : j], coded[j]) for j in range(self.order, len(coded))]

    def chance(self, context, byte):
        known, lp = set(), 0.0
        for k in range(self.order, -1, -1):
            here = self.trie.get(context[self.order - k :], {})
            live = {b: n for b, n in here.items() if b not in known}
            total = sum(live.values()) + len(live)
            if byte in live:
                return lp + math.log10(live[byte] / total)
            if live:
                lp += math.log10(len(live) / total)
            known |= set(here)
        return lp - math.log10(256 - len(known))

    def score(self, text):
        return sum(self.chance(c, b) for c, b in self.bytes_of(text))


def viterbi(word, scores, unknown):
    """Best segmentation by total score; ties as the fold has them are avoided by the tests."""
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            gain = scores.get(piece, unknown if end - start == 1 else None)
            if gain is not None and best[start] is not None:
                cand = (best[start][0] + gain, best[start][1] + [piece])
                if best[end] is None or cand[0] > best[end][0]:
                    best[end] = cand
    return best[-1]
