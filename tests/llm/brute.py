"""Plain Python answers that the operators are held against."""

import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingles(text, width):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def jaccard_classes(docs, share, width):
    """{id: (set size, smallest linked id)} for (id, text) rows."""
    sets = {i: shingles(t, width) for i, t in docs}
    union, lists = Union(), defaultdict(list)
    for i, s in sets.items():
        union.find(i)
        common = defaultdict(int)
        for g in s:
            for j in lists[g]:
                common[j] += 1
            lists[g].append(i)
        for j, k in common.items():
            if 100 * k >= share * (len(s) + len(sets[j]) - k):
                union.join(i, j)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


def substring_distance(pattern, text):
    """Fewest edits between `pattern` and any part of `text`."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)
