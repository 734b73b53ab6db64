"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    words = WORD.findall(lowered(text))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 75 * (len(a) + len(b) - both)


def component_of(nodes, linked):
    """Smallest node reachable; ``linked(a, b)`` is asked for every pair."""
    nodes = sorted(set(nodes))
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def later_lines(documents):
    """(doc_id, line) of the lines that match an earlier line."""
    lines = []
    for doc_id, text in documents:
        if doc_id is not None and text is not None:
            lines += [((doc_id, i), shingles(line)) for i, line in enumerate(text.split("\n"))]
    return {b for b, y in lines for a, x in lines if a < b and similar(x, y)}


def base_measures(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
