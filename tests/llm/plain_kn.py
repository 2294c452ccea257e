"""A plain interpolated modified Kneser-Ney model of characters, in dictionaries."""

import math
from collections import Counter, defaultdict


def symbols(text):
    return [None] * 3 + ["U+" if c.isupper() else "D+" if c.isdigit() else c for c in text] + [None]


def grams(text):
    s = symbols(text)
    return [tuple(s[i : i + 4]) for i in range(len(s) - 3)]


class Plain:
    def __init__(self, texts):
        self.c = {4: Counter(g for t in texts for g in grams(t))}
        for n in (3, 2, 1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.total, self.left, self.d = {}, {}, {}
        for n in (1, 2, 3, 4):
            of = Counter(self.c[n].values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
            self.d[n] = [0.0] + [min(max(i - (i + 1) * y * of[i + 1] / of[i] if of[i] else i / 2, 0.05), i - 0.05) for i in (1, 2, 3)]
            self.total[n], self.left[n] = defaultdict(int), defaultdict(float)
            for g, k in self.c[n].items():
                self.total[n][g[:-1]] += k
                self.left[n][g[:-1]] += self.d[n][min(k, 3)]

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(self.c[1]) + 1)
        before, lower = gram[:-1], self.p(gram[1:])
        total = self.total[n].get(before, 0)
        if not total:
            return lower
        k = self.c[n].get(gram, 0)
        return (k - self.d[n][min(k, 3)] + self.left[n][before] * lower) / total

    def log10(self, text):
        return sum(math.log10(self.p(g)) for g in grams(text))

    def perplexity(self, text):
        return 10 ** (-self.log10(text) / (len(text) + 1)) if text else None
