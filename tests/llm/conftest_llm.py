"""Helpers that the tests of this folder share."""


def words(text):
    return (text or "").encode().lower().split()


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def bag(w, k):
    out = {}
    for i in range(len(w) - k + 1):
        out[tuple(w[i : i + k])] = out.get(tuple(w[i : i + k]), 0) + 1
    return out


def components(texts):
    """Least index reachable from each text over links of its shingle set."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def contaminated(text, items):
    """Items of which a window of as many words has a weighted similarity of 0.75."""
    w, out = words(text), set()
    for item, t in items:
        own = words(t)
        if not own:
            continue
        k = min(5, len(own))
        target = bag(own, k)
        for s in range(max(1, len(w) - len(own) + 1)):
            window = bag(w[s : s + len(own)], k)
            shared = sum(min(n, target.get(g, 0)) for g, n in window.items())
            total = sum(window.values()) + sum(target.values()) - shared
            if shared and 100 * shared >= 75 * total:
                out.add(item)
                break
    return out


def repeated(rows, length=50):
    """Word places of (id, text) rows in runs that a lesser id has too, or the text itself ``length`` words before; by row."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w, own, gone = words(t), {}, set()
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            if first[g] < i or own.setdefault(g, k) <= k - length:
                gone.update(range(k, k + length))
        out.append(gone)
    return out
