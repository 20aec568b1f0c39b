"""Plain versions of what the engine computes, for tests on small inputs."""

from __future__ import annotations

import itertools
import random


def matches(motif, edges) -> set[tuple[int, ...]]:
    """All homomorphisms of a motif."""
    nodes = {x for e in edges for x in e}
    edges = set(edges)
    return {m for m in itertools.product(nodes, repeat=motif.width) if all((m[a], m[b]) in edges for a, b in motif.edges)}


def random_edges(seed: int, nodes: int, n: int) -> set[tuple[int, int]]:
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        a, b = rnd.randrange(nodes), rnd.randrange(nodes)
        if a != b:
            out.add((a, b))
    return out


def undirected(edges) -> set[tuple[int, int]]:
    return {(min(e), max(e)) for e in edges}


def cliques(edges, k: int) -> set[tuple[int, ...]]:
    f = undirected(edges)
    nodes = sorted({x for e in f for x in e})
    return {c for c in itertools.combinations(nodes, k) if all(p in f for p in itertools.combinations(c, 2))}


def snapshots(log, epochs) -> dict[int, set[tuple[int, int]]]:
    """Epoch by epoch: a positive sum of an edge's weights inserts it, a negative one deletes it."""
    out, held = {}, set()
    for t in range(min([x[2] for x in log], default=0), max(epochs) + 1):
        net: dict[tuple[int, int], int] = {}
        for s, d, at, w in log:
            if at == t:
                net[s, d] = net.get((s, d), 0) + w
        held = (held | {e for e, n in net.items() if n > 0}) - {e for e, n in net.items() if n < 0}
        out[t] = set(held)
    return {t: out.get(t, set()) for t in epochs}
