"""Brute-force twins on plain Python, for small inputs."""

import random


def tanimoto(a, b):
    a, b = set(a), set(b)
    union = len(a | b)
    return len(a & b) / union if union else 0.0


def random_sets(n, n_bits, seed, low=1, high=8, copies=0):
    rng = random.Random(seed)
    sets = [sorted(rng.sample(range(n_bits), rng.randint(low, high))) for _ in range(n - copies)]
    return list(enumerate(sets + [sets[0]] * copies))


def brute_edges(items, threshold, inclusive=False):
    out = {}
    for x, (i, a) in enumerate(items):
        for j, b in items[x + 1 :]:
            s = tanimoto(a, b)
            if s > threshold or (inclusive and s >= threshold):
                out[(i, j)] = s
    return out


def components(ids, edges):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def leaders(ids, edges, key):
    around = {i: set() for i in ids}
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    of = {}
    for v in sorted(ids, key=lambda i: (key(i, around), i)):
        if v in of:
            continue
        of[v] = v
        for w in around[v]:
            of.setdefault(w, v)
    return of


def lo(items, values, threshold, min_cluster_size, max_clusters, std_threshold):
    """One-at-a-time lead-optimisation split: id -> (set, cluster)."""
    alive = [i for i, _ in items]
    bits = dict(items)
    out = {}
    for cluster in range(max_clusters):
        counts, spreads = {}, {}
        for i in alive:
            near = [values[j] for j in alive if tanimoto(bits[i], bits[j]) > threshold]
            counts[i] = len(near)
            mean = sum(near) / len(near)
            spreads[i] = (sum((v - mean) ** 2 for v in near) / len(near)) ** 0.5
        best, least = None, max(counts.values(), default=0)
        for i in alive:
            if min_cluster_size < counts[i] < least and spreads[i] >= std_threshold - 1e-12:
                best, least = i, counts[i]
        if best is None:
            break
        core = [j for j in alive if j != best and tanimoto(bits[best], bits[j]) > threshold]
        for j in alive:
            if any(tanimoto(bits[j], bits[c]) >= threshold for c in [*core, best]):
                out[j] = ("discard", None)
        for j in core:
            out[j] = ("test", cluster)
        out[best] = ("train", None)
        alive = [j for j in alive if j not in out]
    for j in alive:
        out[j] = ("train", None)
    return out
