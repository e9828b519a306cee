"""Slow, plain versions to test against."""

from collections import deque


def cores(edges):
    """Coreness by peeling one vertex at a time."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left, core, k = {v: set(n) for v, n in near.items()}, {}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for u in left.pop(v):
            left[u].discard(v)
    return core


def layers(edges):
    out, left = {}, set(edges)
    while left:
        core = cores(left)
        k = max(core.values())
        top = {e for e in left if core[e[0]] == k and core[e[1]] == k}
        out |= dict.fromkeys(top, k)
        left -= top
    return out


def waves(edges, k):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, w, t = {}, 0, k
    while near:
        t, f = max(t, min(map(len, near.values()))), 0
        while True:
            go = [v for v, n in near.items() if (len(n) <= t if f == 0 else len(n) < t)]
            if not go:
                break
            for v in go:
                out[v] = (w, f)
            for v in go:
                for u in near.pop(v):
                    if u in near:
                        near[u].discard(v)
            f += 1
        w += 1
    return out


def distances(edges, sources):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, todo = dict.fromkeys(sources, 0), deque(sources)
    while todo:
        v = todo.popleft()
        for u in near.get(v, ()):
            if u not in dist:
                dist[u] = dist[v] + 1
                todo.append(u)
    return dist


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(root)}
