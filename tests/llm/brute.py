"""Plain loops that operators are held against."""

import re


def shingle_set(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_components(rows, percent=80):
    """{position: (set size, least id reachable)} of (id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = {}
    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in lists.setdefault(x, []):
                seen[j] = seen.get(j, 0) + 1
            lists[x].append(i)
        for j, both in seen.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (name, _) in enumerate(rows):
        r = find(i)
        if name is not None:
            least[r] = min(least.get(r, name), name)
    return {i: (len(sets[i]), least.get(find(i))) for i in range(len(rows))}


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def bench_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(texts, items, window=10):
    """For each text: (words, hit word numbers, item ids)."""
    windows = {}
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    lengths = sorted({len(w) for w in windows})
    out = []
    for text in texts:
        w, hit, ids = bench_words(text), set(), set()
        for i in range(len(w)):
            for n in lengths:
                if found := windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None:
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((len(w), hit, ids))
    return out
