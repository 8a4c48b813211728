"""Brute-force versions shared by the tests."""

from tessera.llm.common import alnum_words, blank_words


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = blank_words(t)
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_hits(words, items, window=13):
    hit, who = set(), set()
    for item, text in items:
        w = alnum_words(text)
        k = min(window, len(w))
        wins = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                who.add(str(item))
    return len(hit), who
