"""The class-conditional Kneser-Ney model by its definition, word by word, which the tables are held against."""

import math
import re
from collections import Counter

from framelake.llm.toxicity import _END, _START, BEGINNING, DISCOUNT, EVIDENCE, SEEN, SHARED


class KneserNey:
    """Log-likelihood ratios of words under the two classes, from counts in memory."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.full = ({}, {})
        self.total, self.types = (Counter(), Counter()), (Counter(), Counter())
        for gram, *counts in rows:
            for c, n in enumerate(counts):
                if n and gram[0] == "<":
                    self.full[c][gram[1:]] = n
                    self.total[c][gram[1:-1]] += n
                    self.types[c][gram[1:-1]] += 1
        self.lower = []  # shared: continuation counts of ever shorter windows
        seen = {r[0][1:] for r in rows if r[0][0] == "="}
        for _ in range(SHARED - 1):
            counts = Counter(g[1:] for g in seen)
            total, types = Counter(), Counter()
            for g, n in counts.items():
                total[g[:-1]] += n
                types[g[:-1]] += 1
            self.lower.append((counts, total, types))
            seen = set(counts)
        self.letters = max(1, len(seen)) + 1  # one more for all unseen letters

    def shared(self, gram: str, k: int = 0) -> float:
        """Probability of the last letter after the others, from the k-th lower order down."""
        if k == len(self.lower):
            return 1.0 / self.letters
        counts, total, types = self.lower[k]
        backoff = self.shared(gram[1:], k + 1)
        n = total.get(gram[:-1], 0)
        if not n:
            return backoff
        return max(counts.get(gram, 0) - DISCOUNT, 0.0) / n + DISCOUNT * types[gram[:-1]] / n * backoff

    def probability(self, beginning: str, toxic: int) -> float:
        """Probability in a class of the last letter of a word's beginning after the others."""
        backoff = self.shared((_START * (SHARED - 2) + beginning)[1 - SHARED :])
        n = self.total[toxic].get(beginning[:-1], 0)
        if not n:
            return backoff
        return max(self.full[toxic].get(beginning, 0) - DISCOUNT, 0.0) / n + DISCOUNT * self.types[toxic][beginning[:-1]] / n * backoff

    def ratio(self, beginning: str) -> float:
        """Log-likelihood ratio of the last letter; the classes share all that follows what the toxic one has hardly seen."""
        if self.total[1].get(beginning[:-1], 0) < SEEN:
            return 0.0
        return math.log(self.probability(beginning, 1)) - math.log(self.probability(beginning, 0))

    def word(self, word: str) -> float:
        marked = (_START + word + _END)[:BEGINNING]
        return sum(self.ratio(marked[:i]) for i in range(2, len(marked) + 1))

    def token(self, token: str) -> float:
        return max([self.word(w) for w in re.findall(r"[^\W\d_]+", token.lower())], default=0.0)

    def features(self, text: str) -> list[float]:
        values = sorted([self.token(t) for t in text.split()], reverse=True)
        n, top = max(1, len(values)), [*values[:5], 0.0, 0.0, 0.0, 0.0, 0.0]
        return [sum(values) / n, top[1], sum(top[:5]) / 5, sum(v for v in values if v > EVIDENCE) / n, math.log1p(len(values))]
