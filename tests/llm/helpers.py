"""Plain versions of what the operators compute, for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[i:] for i in range(width)]))


def groups(ids, links):
    """The smallest id that links reach, for every id."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def similar_pairs(sets, percent=75):
    lists, common = defaultdict(list), Counter()
    for i, s in sorted(sets.items()):
        for t in s:
            lists[t].append(i)
    for found in lists.values():
        common.update((a, b) for k, a in enumerate(found) for b in found[k + 1 :])
    return [
        (a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]
