"""Plain versions of what the operators compute, for the tests."""

import hashlib
import re


def contamination(texts, items, window=13):
    """[(n_words, n_hit, n_items, items_sha256, contaminated)] of texts; items: [(id, text)]."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    wanted = []
    for i, t in items:
        w = word.findall(lower(t))
        n = min(window, len(w))
        wanted += [(str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1) if i is not None and n]
    out = []
    for t in texts:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for i, run in wanted:
            for k in range(len(w) - len(run) + 1):
                if tuple(w[k : k + len(run)]) == run:
                    hit.update(range(k, k + len(run)))
                    found.add(i)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]
