"""Plain definitions of what the operators compute."""

from collections import defaultdict
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63


def windows_removed(rows: list[tuple], window: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept words) of rows (doc_id, text)."""
    first: dict[tuple, int] = {}
    split = [(LAST if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    for order, _, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, order), order)
    out = []
    for order, i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text: str | None, size: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))) if w else frozenset()


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        top[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def jaccard(rows: list[tuple], size: int, percent: int) -> list[tuple]:
    """(doc_id, set size, smallest id of the component) of rows (doc_id, text)."""
    sets = [shingles(t, size) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    classes = components(len(rows), links)
    members = defaultdict(list)
    for k, c in enumerate(classes):
        members[c].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min((i for i in members[c] if i is not None), default=None)) for k, c in enumerate(classes)]
