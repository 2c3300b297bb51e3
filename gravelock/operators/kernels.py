"""What is done inside one graph, in plain Python and NumPy: graphs are small, tables of them are large.

Facts and nodes are bits of Python integers. An exploit is (id, granted, required, probability).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

INF = float("inf")


@dataclass(frozen=True)
class Exploit:
    id: int
    granted: int
    required: int  # a bit for each proposition
    p: float


@dataclass
class Spec:
    goal: int
    propositions: list[int]
    initial: int
    exploits: list[Exploit]

    @classmethod
    def of(cls, goal: int, propositions, exploits) -> Spec:
        bit = {p["id_proposition"]: i for i, p in enumerate(propositions)}
        return cls(
            bit[goal],
            [p["id_proposition"] for p in propositions],
            sum(1 << bit[p["id_proposition"]] for p in propositions if p["initial"]),
            [Exploit(x["id_exploit"], bit[x["granted"]], sum({1 << bit[r] for r in x["required"]}), probability(x["cvss"])) for x in exploits],
        )


def probability(cvss: float | None) -> float:
    """NaN where there is no score: what is worked out from it says so."""
    return float("nan") if cvss is None else cvss / 10


def bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def useful(spec: Spec) -> list[Exploit]:
    """Exploits from which the goal can be reached backwards."""
    need, kept = 1 << spec.goal, set()
    while more := [x for x in spec.exploits if x.id not in kept and need >> x.granted & 1]:
        kept |= {x.id for x in more}
        for x in more:
            need |= x.required
    return [x for x in spec.exploits if x.id in kept]


def pruned_dependency(spec: Spec, removed: int | None = None) -> tuple[int, list[Exploit]]:
    """(propositions, exploits) left when an exploit goes; each round drops what the round before made useless."""
    props, exploits = (1 << len(spec.propositions)) - 1, [x for x in spec.exploits if x.id != removed]
    goal = 1 << spec.goal
    while True:
        used = granted = 0
        for x in exploits:
            used |= x.required & props
            granted |= (1 << x.granted) & props
        dead = (props & ~used & ~goal) | (props & ~granted & ~spec.initial)
        kept = [x for x in exploits if props >> x.granted & 1 and x.required & ~props == 0]
        if not dead and len(kept) == len(exploits):
            return props, exploits
        if dead & goal:
            goal = 0  # a goal that cannot be reached is none
        props, exploits = props & ~dead, kept


@dataclass
class States:
    """States by level; edges (src, dst) -> exploits; state 0 is the start."""

    masks: list[int]
    edges: dict[tuple[int, int], list[Exploit]]
    goal: int

    def is_goal(self, i: int) -> bool:
        return bool(self.masks[i] >> self.goal & 1)


def expanded(spec: Spec, max_states: int = 1_000_000) -> States:
    """All sets of facts that can come true, one exploit at a time; goal states lead nowhere."""
    moves = useful(spec)
    number, masks, edges = {spec.initial: 0}, [spec.initial], {}
    for src, mask in enumerate(masks):  # grows while it is read
        if mask >> spec.goal & 1:
            continue
        for x in moves:
            if not mask >> x.granted & 1 and x.required & ~mask == 0:
                to = mask | 1 << x.granted
                if to not in number:
                    if len(masks) >= max_states:
                        raise ValueError(f"more than {max_states} states")
                    number[to] = len(masks)
                    masks.append(to)
                edges.setdefault((src, number[to]), []).append(x)
    return States(masks, edges, spec.goal)


def pruned_states(full: States, removed: int | None) -> States | None:
    """Without an exploit: what the start reaches and from which a goal is reached; None if the goal is lost."""
    edges = {e: left for e, xs in full.edges.items() if (left := [x for x in xs if x.id != removed])}
    out, into = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)

    def closure(begin: list[int], step: dict[int, list[int]]) -> set[int]:
        seen, work = set(begin), list(begin)
        while work:
            for b in step.get(work.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    work.append(b)
        return seen

    there = closure([0], out)
    kept = there & closure([i for i in there if full.is_goal(i)], into)
    if 0 not in kept:
        return None
    order = sorted(kept)
    new = {old: i for i, old in enumerate(order)}
    return States([full.masks[i] for i in order], {(new[a], new[b]): xs for (a, b), xs in edges.items() if a in kept and b in kept}, full.goal)


class Chain:
    """A state graph's edges as arrays, with the largest probability of each edge's exploits."""

    def __init__(self, s: States):
        self.n = len(s.masks)
        self.src = np.array([a for a, _ in s.edges], np.int64)
        self.dst = np.array([b for _, b in s.edges], np.int64)
        self.p = np.array([max(x.p for x in xs) for xs in s.edges.values()], float)
        self.goal = np.array([s.is_goal(i) for i in range(self.n)])
        total = np.bincount(self.src, self.p, self.n)
        self.sink = np.bincount(self.src, minlength=self.n) == 0
        self.w = self.p / total[self.src] if len(self.src) else self.p

    def forward(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.dst, w * v[self.src], self.n)


def settled(step, x: np.ndarray, tol: float, max_iter: int) -> np.ndarray:
    """Steps until the L2 change is at most tol (never, if negative), max_iter at most."""
    for _ in range(max_iter):
        new = step(x)
        small = np.sqrt(((new - x) ** 2).sum()) <= tol
        x = new
        if small:
            break
    return x


def page_rank(c: Chain, d: float = 0.85, tol: float = 1e-4, max_iter: int = 10_000) -> float:
    """Share of the goals. A state sends 1-d to the start, a sink d (and so loses the rest)."""
    back = np.where(c.sink, d, 1 - d)

    def step(r: np.ndarray) -> np.ndarray:
        new = c.forward(r, d * c.w)
        new[0] += (back * r).sum()
        return new

    return float(settled(step, np.full(c.n, 1 / c.n), tol, max_iter)[c.goal].sum())


def kuehlmann(c: Chain, eta: float = 0.85, max_m: int = 100, forward: bool = False) -> float:
    """Discounted sums of powers of the chain, at the goals. By default the powers are applied as the known
    method has them, backwards from the start, which no edge enters, so every score is 0; `forward` is the
    sense that the method describes."""
    v = np.zeros(c.n)
    v[0] = 1
    sums, total = v.copy(), np.zeros(c.n)
    for m in range(1, max_m + 1):
        v = c.forward(v, c.w) if forward else np.bincount(c.src, c.w * v[c.dst], c.n)
        sums = sums + v
        total += eta**m * sums
        if v.sum() < 1e-15:  # a graph without cycles has no longer ways
            break
    return float(total[c.goal].sum() * (1 - eta) / eta)


def value_iteration(src, dst, p, reward, n: int, lamb: float = 0.9, tol: float = 1e-4, max_iter: int = 10_000) -> np.ndarray:
    """Sinks are worth 1; else reward + the best move's lamb * (p V(dst) + (1-p) V(src))."""
    sink = np.bincount(src, minlength=n) == 0

    def step(v: np.ndarray) -> np.ndarray:
        new = np.full(n, -INF)
        np.maximum.at(new, src, lamb * (p * v[dst] + (1 - p) * v[src]))
        return np.where(sink, 1.0, reward + new)

    return settled(step, np.zeros(n), tol, max_iter)


def value_of_states(c: Chain, **how) -> float:
    return float(value_iteration(c.src, c.dst, c.p, c.goal.astype(float), c.n, **how)[0])


def value_of_facts(spec: Spec, props: int, exploits: list[Exploit], **how) -> float:
    """On the dependency graph: a fact's moves are free, an exploit's has its probability."""
    place = {b: i for i, b in enumerate(bits(props))}
    n = len(place) + len(exploits)
    moves = [(place[r], len(place) + i, 1.0) for i, x in enumerate(exploits) for r in bits(x.required)] + [(len(place) + i, place[x.granted], x.p) for i, x in enumerate(exploits)]
    src, dst, p = (np.array(c) for c in zip(*moves, strict=True))
    reward = np.zeros(n)
    reward[place[spec.goal]] = 1
    v = value_iteration(src, dst, p.astype(float), reward, n, **how)
    return float(sum(v[place[b]] for b in bits(spec.initial & props)))


def path_probability(c: Chain) -> float:
    """Mass from the start that ends in goals; edges run to later states, so one pass does."""
    mass = np.zeros(c.n)
    mass[0] = 1
    for i in np.lexsort((c.dst, c.src)):
        mass[c.dst[i]] += mass[c.src[i]] * c.w[i]
    return float(mass[c.goal].sum())


class Risk:
    """Probability that each node comes true, conditioned on separating branch nodes.

    Node sets are integers; a joint event is a pair (true nodes, false nodes). For a node, `reach` has the
    branch nodes above it and `must` those on every way to it.
    """

    def __init__(self, spec: Spec, props: int, exploits: list[Exploit], max_separators: int = 16):
        self.max_separators = max_separators
        facts = bits(props & ~spec.initial)
        place = {b: i + 1 for i, b in enumerate(facts)}  # node 0 is the root
        first = len(place) + 1
        self.above = {place[b]: 0 for b in facts}
        self.p = {}
        below = dict.fromkeys(range(first + len(exploits)), 0)
        for i, x in enumerate(exploits):
            node = first + i
            need = sum(1 << place[b] for b in bits(x.required) if b in place) or 1
            self.above[node], self.p[node] = need, x.p
            if x.granted in place:
                self.above[place[x.granted]] |= 1 << node
                below[node] += 1
            for up in bits(need):
                below[up] += 1
        self.branch = sum(1 << k for k, n in below.items() if n > 1)
        self.phi, self.reach, self.must = {0: 1.0}, {0: 0}, {0: 0}
        self.joints: dict[tuple[int, int], float] = {}
        self.given: dict[tuple[int, int, int], float] = {}
        everything, waiting = (1 << first + len(exploits)) - 1, dict(self.above)
        while waiting:
            ready = [k for k, need in waiting.items() if all(u in self.phi for u in bits(need))]
            if not ready:
                raise ValueError("the graph has a cycle")
            for k in ready:
                need = waiting.pop(k)
                ups = bits(need)
                union = 0
                for u in ups:
                    union |= self.reach[u]
                if k in self.p:
                    self.phi[k] = self.p[k] * self.joint(need, 0)
                    own = self.branch & need
                    self.reach[k], self.must[k] = union | own, own
                    for u in ups:
                        self.must[k] |= self.must[u]
                else:
                    self.phi[k] = 1 - self.joint(0, need)
                    self.reach[k], self.must[k] = union, everything
                    for u in ups:
                        self.must[k] &= self.must[u]
        self.goal = self.phi[place[spec.goal]] if spec.goal in place else 1.0

    def joint(self, yes: int, no: int) -> float:
        if (yes, no) not in self.joints:
            nodes, shared = bits(yes | no), 0
            for i, a in enumerate(nodes):
                for b in nodes[i + 1 :]:
                    shared |= self.reach[a] & self.reach[b]
            if not shared:
                value = 1.0
                for k in nodes:
                    value *= self.phi[k] if yes >> k & 1 else 1 - self.phi[k]
            else:
                if shared.bit_count() > self.max_separators:
                    raise ValueError(f"more than {self.max_separators} separating nodes")
                value, part = 0.0, shared
                while True:  # every subset of the separators as the true ones
                    value += self.conditional(yes, no, part, shared) * self.joint(part, shared & ~part)
                    if not part:
                        break
                    part = (part - 1) & shared
            self.joints[yes, no] = value
        return self.joints[yes, no]

    def conditional(self, yes: int, no: int, true: int, of: int) -> float:
        value = 1.0
        for k in bits(yes):
            value *= self.single(k, true, of)
        for k in bits(no):
            value *= 1 - self.single(k, true, of)
        return value

    def single(self, k: int, true: int, of: int) -> float:
        key = (k, true, of)
        if key not in self.given:
            false, bit = of & ~true, 1 << k
            if true & bit:
                value = 1.0
            elif false & (bit | self.must[k]):
                value = 0.0
            elif not of & self.reach[k]:
                value = self.phi[k]
            elif k in self.p:
                value = self.p[k] * self.conditional(self.above[k], 0, true, of)
            else:
                value = 1 - self.conditional(0, self.above[k], true, of)
            self.given[key] = value
        return self.given[key]


def exact_risk(spec: Spec, props: int, exploits: list[Exploit], max_exploits: int = 20) -> float:
    """The goal's probability by going through all outcomes of the exploits."""
    if len(exploits) > max_exploits:
        raise ValueError(f"more than {max_exploits} exploits")
    outcome = np.arange(1 << len(exploits))
    true = np.full(len(outcome), spec.initial & props, np.int64)
    chance = np.ones(len(outcome))
    for i, x in enumerate(exploits):
        works = outcome >> i & 1 == 1
        chance *= np.where(works, x.p, 1 - x.p)
    for _ in exploits:
        for i, x in enumerate(exploits):
            on = (outcome >> i & 1 == 1) & (true & x.required == x.required)
            true |= np.where(on, 1 << x.granted, 0)
    return float(chance[true >> spec.goal & 1 == 1].sum())


METHODS = ("pagerank", "kuehlmann", "kuehlmann_forward", "value_iteration_state", "probabilistic_path", "value_iteration_dependency", "homer", "exact", "random")


def scores(spec: Spec, removed: list[int | None], methods: list[str], seed: int = 0, tol: float = 1e-4, max_iter: int = 10_000) -> list[tuple[str, int | None, float]]:
    """(method, removed exploit, score) for each; -inf where the goal is lost."""
    out, full = [], None
    how = {"tol": tol, "max_iter": max_iter}
    for e in removed:
        props, exploits = pruned_dependency(spec, e)
        lost, chain = not props >> spec.goal & 1, None
        for m in methods:
            if m == "random":
                value = float(np.random.default_rng([seed, 0 if e is None else e + 1]).random())
            elif lost:
                value = -INF
            elif m in ("value_iteration_dependency", "homer", "exact"):
                value = value_of_facts(spec, props, exploits, **how) if m[0] == "v" else Risk(spec, props, exploits).goal if m == "homer" else exact_risk(spec, props, exploits)
            else:
                full = full or expanded(spec)
                chain = chain or Chain(pruned_states(full, e))
                value = {"pagerank": lambda: page_rank(chain, **how), "kuehlmann": lambda: kuehlmann(chain), "kuehlmann_forward": lambda: kuehlmann(chain, forward=True), "value_iteration_state": lambda: value_of_states(chain, **how), "probabilistic_path": lambda: path_probability(chain)}[m]()
            out.append((m, e, value))
    return out
