"""Shared brute-force versions."""

import re

from tripleframe.llm.common import ascii_words


def plain_words(text) -> list:
    """Runs of letters and digits, lower-cased."""
    return re.findall(r"[^\W_]+", text.lower()) if text else []


def brute_near_kept(texts: dict, size: int) -> set:
    """Documents that stay: the smallest of each group at Jaccard 0.8."""
    sets = {}
    for d, t in texts.items():
        w = ascii_words(t)
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d for d in sets if root(d) == d}
