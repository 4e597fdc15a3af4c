"""Exact algorithms on one problem, over plain arrays. The grouped operators call them, once for each problem."""

from __future__ import annotations

import heapq
import time
from collections import deque

import numpy as np


class Infeasible(Exception):
    pass


class Limit(Exception):
    pass


class Residual:
    """Arcs in pairs: arc i and its reverse i ^ 1."""

    def __init__(self, n: int):
        self.n, self.to, self.cap, self.cost, self.out = n, [], [], [], [[] for _ in range(n)]

    def add(self, u: int, v: int, cap: int, cost: int = 0) -> int:
        i = len(self.to)
        self.to += [v, u]
        self.cap += [cap, 0]
        self.cost += [cost, -cost]
        self.out[u].append(i)
        self.out[v].append(i + 1)
        return i


class Bundles:
    """Parallel arcs, cheapest first, as one: only the cheapest that has room and the dearest that has flow are residual arcs. Bundle b goes from
    tail[b] to head[b]; its arcs before at[b] are full, and that one holds held[b]. Residual arc 2 b goes ahead, 2 b + 1 back."""

    def __init__(self, n: int, src, dst, cap, cost):
        self.out, self.tail, self.head, self.edges = [[] for _ in range(n)], [], [], []
        places: dict[tuple[int, int], int] = {}
        for e, (u, v, c) in enumerate(zip(src, dst, cap, strict=True)):
            if c > 0 and u != v:
                b = places.setdefault((u, v), len(self.tail))
                if b == len(self.tail):
                    self.tail.append(u)
                    self.head.append(v)
                    self.edges.append([])
                    self.out[u].append(2 * b)
                    self.out[v].append(2 * b + 1)
                self.edges[b].append(e)
        for own in self.edges:
            own.sort(key=lambda e: cost[e])
        self.caps, self.costs = [[cap[e] for e in own] for own in self.edges], [[cost[e] for e in own] for own in self.edges]
        self.at, self.held = [0] * len(self.edges), [0] * len(self.edges)

    def arc(self, i: int) -> tuple[int, int]:
        """Room and cost of a residual arc."""
        b, at = i >> 1, self.at[i >> 1]
        if not i & 1:
            return (self.caps[b][at] - self.held[b], self.costs[b][at]) if at < len(self.caps[b]) else (0, 0)
        if self.held[b]:
            return self.held[b], -self.costs[b][at]
        return (self.caps[b][at - 1], -self.costs[b][at - 1]) if at else (0, 0)

    def to(self, i: int) -> int:
        return self.tail[i >> 1] if i & 1 else self.head[i >> 1]

    def push(self, i: int, x: int) -> None:
        """x is at most the arc's room."""
        b = i >> 1
        if not i & 1:
            self.held[b] += x
            if self.held[b] == self.caps[b][self.at[b]]:
                self.at[b], self.held[b] = self.at[b] + 1, 0
        elif self.held[b]:
            self.held[b] -= x
        else:
            self.at[b] -= 1
            self.held[b] = self.caps[b][self.at[b]] - x

    def flows(self, flow: list[int]) -> None:
        """Adds what the arcs hold to the flow of their edges."""
        for own, caps, at, held in zip(self.edges, self.caps, self.at, self.held, strict=True):
            for e, c in zip(own[:at], caps[:at], strict=True):
                flow[e] += c
            if held:
                flow[own[at]] += held


def _distances(g: Bundles, n: int, excess: list[int], pi: list[int]) -> list | None:
    """Shortest distances under potentials from all nodes in excess, none if nothing that lacks is reached; beyond the last of these that is
    reached, its distance."""
    dist: list = [None] * n
    heap, settled, far = [(0, v) for v in range(n) if excess[v] > 0], [False] * n, None
    for _, v in heap:
        dist[v] = 0
    left = sum(e < 0 for e in excess)
    while heap and left:
        d, u = heapq.heappop(heap)
        if settled[u]:
            continue
        settled[u] = True
        if excess[u] < 0:
            far, left = d, left - 1
        base = d + pi[u]
        for i in g.out[u]:
            room, cost = g.arc(i)
            if room:
                v = g.to(i)
                new = base + cost - pi[v]
                if not settled[v] and (dist[v] is None or new < dist[v]):
                    dist[v] = new
                    heapq.heappush(heap, (new, v))
    return None if far is None else [dist[v] if settled[v] and dist[v] < far else far for v in range(n)]


def _push_all(g: Bundles, n: int, excess: list[int], pi: list[int], pushed) -> None:
    """Sends what is in excess along arcs of reduced cost 0 until no path of such arcs is left; pushed is called for each."""
    turn, dead = [0] * n, [False] * n
    for s in range(n):
        while excess[s] > 0 and not dead[s]:
            path, on, u = [], {s}, s
            while excess[u] >= 0:
                while turn[u] < len(g.out[u]):
                    i = g.out[u][turn[u]]
                    room, cost = g.arc(i)
                    v = g.to(i)
                    if room and cost + pi[u] - pi[v] == 0 and not dead[v] and v not in on:
                        break
                    turn[u] += 1
                if turn[u] < len(g.out[u]):
                    path.append(i)
                    on.add(v)
                    u = v
                else:
                    dead[u] = True
                    if not path:
                        break
                    on.discard(u)
                    u = g.to(path.pop() ^ 1)
            if excess[u] < 0:
                x = min(excess[s], -excess[u], *[g.arc(i)[0] for i in path])
                for i in path:
                    g.push(i, x)
                excess[s] -= x
                excess[u] += x
                pushed()


def min_cost_flow(n, src, dst, lower, upper, cost, demand, max_augmentations=None, deadline=None):
    """Flow of each edge and a potential of each node; cost + potential[src] - potential[dst] is at least 0 on residual arcs.

    Lower bounds go into the demands, arcs of negative cost are filled first, so that no residual arc is negative. Then phases of
    Dijkstra under potentials, after each of which all that is in excess goes along shortest paths to where it lacks, as far as these
    have room."""
    base, excess = [], [-int(d) for d in demand]
    for u, v, lo, up, c in zip(src, dst, lower, upper, cost, strict=True):
        base.append(up if c < 0 else lo)
        excess[u] -= base[-1]
        excess[v] += base[-1]
    # An arc of negative cost stands the other way round: what it sends back is taken from its fill.
    turned = [c < 0 for c in cost]
    g = Bundles(n, [v if t else u for u, v, t in zip(src, dst, turned, strict=True)], [u if t else v for u, v, t in zip(src, dst, turned, strict=True)], [up - lo for lo, up in zip(lower, upper, strict=True)], [abs(c) for c in cost])
    pi, rounds = [0] * n, 0

    def pushed():
        nonlocal rounds
        rounds += 1
        if max_augmentations is not None and rounds > max_augmentations or deadline and time.monotonic() > deadline:
            raise Limit

    while any(e > 0 for e in excess):
        dist = _distances(g, n, excess, pi)
        if dist is None:
            raise Infeasible
        pi = [p + d for p, d in zip(pi, dist, strict=True)]
        _push_all(g, n, excess, pi, pushed)
    if any(excess):
        raise Infeasible
    moved = [0] * len(base)
    g.flows(moved)
    return [b - m if t else b + m for b, m, t in zip(base, moved, turned, strict=True)], pi


def max_flow(n, src, dst, cap, s, t, undirected=False):
    """Value, flow of each edge, and the source side of the smallest minimum cut (Dinic)."""
    g = Residual(n)
    for u, v, c in zip(src, dst, cap, strict=True):
        i = g.add(u, v, int(c))
        if undirected:
            g.cap[i + 1] = int(c)
    total = 0
    while s != t:
        level, queue = [-1] * n, deque([s])
        level[s] = 0
        while queue:
            u = queue.popleft()
            for i in g.out[u]:
                if g.cap[i] and level[g.to[i]] < 0:
                    level[g.to[i]] = level[u] + 1
                    queue.append(g.to[i])
        if level[t] < 0:
            break
        at, path, u = [0] * n, [], s
        while True:
            if u == t:
                push = min(g.cap[i] for i in path)
                total += push
                for i in path:
                    g.cap[i] -= push
                    g.cap[i ^ 1] += push
                first = next(k for k, i in enumerate(path) if not g.cap[i])
                u = g.to[path[first] ^ 1]
                del path[first:]
            elif at[u] < len(g.out[u]):
                i = g.out[u][at[u]]
                if g.cap[i] and level[g.to[i]] == level[u] + 1:
                    path.append(i)
                    u = g.to[i]
                else:
                    at[u] += 1
            elif path:
                i = path.pop()
                u = g.to[i ^ 1]
                at[u] += 1
            else:
                break
    side, queue = {s}, deque([s])
    while queue:
        u = queue.popleft()
        for i in g.out[u]:
            if g.cap[i] and g.to[i] not in side:
                side.add(g.to[i])
                queue.append(g.to[i])
    flow = [int(c) - g.cap[2 * k] for k, c in enumerate(cap)]
    return total, flow, side


def matching(left: list, right: list, edges: list[tuple]) -> list[tuple]:
    """Least weight among the matchings of most edges: (left, right) pairs, from a flow of unit arcs."""
    li, ri = {x: i for i, x in enumerate(sorted(left))}, {x: i for i, x in enumerate(sorted(right))}
    a, b = len(li), len(ri)
    best: dict[tuple, int] = {}
    for u, v, w in edges:
        best[u, v] = min(w, best.get((u, v), w))
    pairs = sorted(best)
    s, t = a + b, a + b + 1
    src = [s] * a + [li[u] for u, _ in pairs] + [a + i for i in range(b)]
    dst = list(range(a)) + [a + ri[v] for _, v in pairs] + [t] * b
    most = max_flow(a + b + 2, src, dst, [1] * len(src), s, t)[0]
    cost = [0] * a + [best[p] for p in pairs] + [0] * b
    demand = [0] * (a + b) + [-most, most]
    flow, _ = min_cost_flow(a + b + 2, src, dst, [0] * len(src), [1] * len(src), cost, demand)
    return [p for p, f in zip(pairs, flow[a : a + len(pairs)], strict=True) if f]


def gomory_hu(nodes: list, edges: list[tuple]) -> list[tuple]:
    """A tree (node, parent, capacity) whose paths' least capacities are all pairs' minimum cuts (Gusfield)."""
    place = {v: i for i, v in enumerate(sorted(nodes))}
    src, dst, cap = [place[e[0]] for e in edges], [place[e[1]] for e in edges], [e[2] for e in edges]
    n = len(place)
    parent, weight = [0] * n, [0] * n
    for i in range(1, n):
        value, _, side = max_flow(n, src, dst, cap, i, parent[i], True)
        weight[i] = value
        for j in range(i + 1, n):
            if j in side and parent[j] == parent[i]:
                parent[j] = i
    name = sorted(nodes)
    return [(name[i], name[parent[i]], weight[i]) for i in range(1, n)]


def sparsest_cut(nodes: list, edges: list[tuple]) -> tuple[float, list]:
    """Least cut / min(|S|, |T|) over the minimum cuts of all pairs; the smaller S, then the first by id, breaks ties."""
    place = {v: i for i, v in enumerate(sorted(nodes))}
    src, dst, cap = [place[e[0]] for e in edges], [place[e[1]] for e in edges], [e[2] for e in edges]
    n, found = len(place), (0.0, 0, [])
    for i in range(n):
        for j in range(i + 1, n):
            value, _, side = max_flow(n, src, dst, cap, i, j, True)
            this = value / min(len(side), n - len(side)), len(side), sorted(side)
            found = this if (i, j) == (0, 1) else min(found, this)
    name = sorted(nodes)
    return found[0], [name[i] for i in found[2]]


def vertex_connectivity(nodes: list, edges: list[tuple]) -> int:
    """Least number of nodes whose removal disconnects the graph; n - 1 for a complete one."""
    place = {v: i for i, v in enumerate(sorted(nodes))}
    n = len(place)
    joined = {(min(place[u], place[v]), max(place[u], place[v])) for u, v, *_ in edges if u != v}
    src = [2 * i for i in range(n)] + [2 * u + 1 for u, v in joined] + [2 * v + 1 for u, v in joined]
    dst = [2 * i + 1 for i in range(n)] + [2 * v for u, v in joined] + [2 * u for u, v in joined]
    cap, least = [1] * n + [n] * (2 * len(joined)), max(0, n - 1)
    for i in range(n):
        for j in range(i + 1, n):
            if (i, j) not in joined:
                least = min(least, max_flow(2 * n, src, dst, cap, 2 * i + 1, 2 * j)[0])
    return least


def negative_cycle(n: int, edges: list[tuple]) -> list[int] | None:
    """Edge numbers, in order, of a closed walk of negative length, by Bellman-Ford from all nodes at 0."""
    dist, came, last = [0] * n, [-1] * n, -1
    for _ in range(n):
        last = -1
        for i, (u, v, w) in enumerate(edges):
            if dist[u] + w < dist[v]:
                dist[v], came[v], last = dist[u] + w, i, v
        if last < 0:
            return None
    for _ in range(n):
        last = edges[came[last]][0]
    cycle, v = [], last
    while True:
        cycle.append(came[v])
        v = edges[came[v]][0]
        if v == last:
            return cycle[::-1]


def isotonic_dag(values, weights, edges: list[tuple[int, int]]) -> list[float]:
    """The weighted least-squares values that do not fall along any edge: blocks are split by maximal upper sets, found as
    minimum cuts, until none improves."""
    n = len(values)
    out = [0.0] * n
    state, order = [0] * n, [[] for _ in range(n)]
    for u, v in edges:
        order[u].append(v)
    for s in range(n):  # a cycle makes the order meaningless
        stack = [(s, iter(order[s]))] if not state[s] else []
        if stack:
            state[s] = 1
        while stack:
            u, it = stack[-1]
            for v in it:
                if state[v] == 1:
                    raise ValueError("the graph has a cycle")
                if not state[v]:
                    state[v] = 1
                    stack.append((v, iter(order[v])))
                    break
            else:
                state[u] = 2
                stack.pop()
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scale = 10**9
    todo = [list(range(n))]
    while todo:
        block = todo.pop()
        weight = sum(weights[i] for i in block)
        mean = sum(weights[i] * values[i] for i in block) / weight
        gain = {i: round(weights[i] * (values[i] - mean) / max(1e-300, max(abs(weights[j] * (values[j] - mean)) for j in block) or 1.0) * scale) for i in block}
        place = {v: k for k, v in enumerate(block)}
        s, t = len(block), len(block) + 1
        src, dst, cap = [], [], []
        for i in block:
            if gain[i] > 0:
                src, dst, cap = src + [s], dst + [place[i]], cap + [gain[i]]
            elif gain[i] < 0:
                src, dst, cap = src + [place[i]], dst + [t], cap + [-gain[i]]
        for u, v in edges:
            if u in place and v in place:
                src, dst, cap = src + [place[u]], dst + [place[v]], cap + [scale * (len(block) + 1)]
        value, _, side = max_flow(len(block) + 2, src, dst, cap, s, t)
        upper = [i for i in block if place[i] in side]
        improves = sum(max(0, gain[i]) for i in block) - value > len(block)  # beyond rounding
        if improves and upper and len(upper) < len(block):
            todo += [upper, [i for i in block if place[i] not in side]]
        else:
            for i in block:
                out[i] = mean
    return out


def isotonic_chain(values: list[float], weights: list[float]) -> list[float]:
    blocks: list[list] = []  # weighted sum, weight, length
    for v, w in zip(values, weights, strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, n = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][2] += n
    return [s / w for s, w, n in blocks for _ in range(n)]


def sinkhorn(a: np.ndarray, row: np.ndarray, rounds: int = 50, column: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Scalings x, y so that diag(x) a diag(y) nears the row targets and the column target."""
    x, y = np.ones(a.shape[0]), np.ones(a.shape[1])
    for _ in range(rounds):
        x = row / np.maximum(a @ y, 1e-12)
        y = column / np.maximum(a.T @ x, 1e-12)
    return x, y
