"""Brute-force versions that several test modules hold operators against."""


def near_kept(rows):
    """(doc_id, text) rows that stay by brute force: five-word shingles, Jaccard 0.8, smallest id of each component."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 5 * small >= 4 * large:
                common = len(sets[a] & sets[b])
                if 5 * common >= 4 * (small + large - common):
                    parent[root(a)] = root(b)
    best = {}
    for k, (i, text) in enumerate(rows):
        rank = (i is None, i or 0)
        best[root(k)] = min(best.get(root(k), (rank, i, text)), (rank, i, text), key=lambda x: x[0])
    return sorted((str(i), text or "") for _, i, text in best.values())
