"""Complete candidate retrieval: Levenshtein automata intersected with a trie of the vocabulary.

The automaton of a word is kept as bit masks, one for each number of errors (the k-error NFA);
walking the trie from the root steps the automaton by one letter, and a branch ends as soon as no
state is left. Every vocabulary word within the distance is found. A second walk finds the words that
differ by listed confusions alone, each counted as one edit however many letters it has.
"""

from __future__ import annotations

END = ""
EQUAL = 0.01  # costs this close are the same

#: (read, meant) pairs that scanners confuse; fixed values.
CONFUSED = [
    ("rn", "m"), ("m", "rn"), ("in", "m"), ("m", "in"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"),
    ("vv", "w"), ("w", "vv"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("c", "o"), ("o", "c"), ("u", "v"), ("v", "u"), ("h", "b"), ("b", "h"), ("i", "l"), ("l", "i"), ("j", "i"),
    ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("0", "o"), ("5", "s"), ("$", "s"), ("@", "a"), ("4", "a"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"),
    ("7", "t"), ("2", "z"), ("(", "c"), ("<", "c"), ("€", "e"), ("ﬁ", "fi"), ("ﬂ", "fl"),
]
CONFUSION = 0.25  # cost of a listed confusion
_BY_READ: dict[str, list[str]] = {}
for _r, _m in CONFUSED:
    _BY_READ.setdefault(_r, []).append(_m)


def trie(words) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[END] = w
    return root


def within(root: dict, word: str, k: int) -> list[str]:
    """All words of the trie at Levenshtein distance k or less."""
    n = len(word)
    mask: dict[str, int] = {}
    for i, c in enumerate(word):
        mask[c] = mask.get(c, 0) | 1 << i
    full, last = (1 << (n + 1)) - 1, 1 << n
    start = [(1 << (e + 1)) - 1 for e in range(k + 1)]  # e deletions of the word's letters
    found: list[str] = []
    stack = [(root, start)]
    while stack:
        node, states = stack.pop()
        for c, child in node.items():
            if c == END:
                if states[k] & last:
                    found.append(child)
                continue
            m = mask.get(c, 0)
            new = [(states[0] & m) << 1]
            for e in range(1, k + 1):
                s, before = states[e], states[e - 1]
                new.append((((s & m) << 1) | before | (before << 1) | (new[e - 1] << 1)) & full)
            if new[k]:
                stack.append((child, new))
    return found


def readings(root: dict, word: str, most: int) -> set[str]:
    """All words of the trie of which the word is a reading with at most ``most`` listed confusions."""
    found: set[str] = set()
    stack = [(root, 0, 0)]
    while stack:
        node, i, used = stack.pop()
        if i == len(word):
            if END in node:
                found.add(node[END])
            continue
        if word[i] in node:
            stack.append((node[word[i]], i + 1, used))
        if used == most:
            continue
        for size in (1, 2):
            for meaning in _BY_READ.get(word[i : i + size], ()) if i + size <= len(word) else ():
                at = node
                for c in meaning:
                    at = at.get(c)
                    if at is None:
                        break
                else:
                    stack.append((at, i + size, used + 1))
    return found


def reading_cost(read: str, meant: str, dear: float = 1.0, most: float = 3.0) -> float:
    """Cheapest way to misread ``meant`` as ``read``: 0.25 a known confusion, ``dear`` another edit."""
    n, m = len(read), len(meant)
    inf = most + 1
    d = [[inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = d[i][j]
            if here > most:
                continue
            if i < n and j < m:
                step = here + (0.0 if read[i] == meant[j] else dear)
                d[i + 1][j + 1] = min(d[i + 1][j + 1], step)
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], here + dear)
                for size in (1, 2):
                    for meaning in _BY_READ.get(read[i : i + size], ()) if i + size <= n else ():
                        if meant.startswith(meaning, j):
                            a, b = i + size, j + len(meaning)
                            d[a][b] = min(d[a][b], here + CONFUSION)
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], here + dear)
    return d[n][m]


def candidates(root: dict, word: str, keep: int = 4) -> list[tuple[str, float]]:
    """(word, cost) of the likeliest meanings, cheapest first: all of the lowest cost, dearer ones up to ``keep`` in all."""
    near = {*within(root, word, 1 if len(word) <= 3 else 2), *readings(root, word, 1 if len(word) <= 3 else 2 if len(word) == 4 else 3)}
    ranked = sorted((reading_cost(word, v), v) for v in near)
    return [(v, c) for i, (c, v) in enumerate(ranked) if i < keep or c <= ranked[0][0] + EQUAL]
