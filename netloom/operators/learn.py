"""Structure learning: hill climbing, PC, MMPC, MMHC and its dynamic form. Control is the driver's; scores and tests read Spark."""

from __future__ import annotations

import itertools
import math
import sys
import time
from collections.abc import Iterable, Sequence
from contextlib import contextmanager

from netloom.functions.special import TOL
from netloom.operators.constraint import MeekRules, SepSets, adjacency, candidates, combinations_of_two_sets, direct_v_structures, v_structure_tests
from netloom.operators.factors import Arguments, CKDEType, FactorType
from netloom.operators.graph import ConditionalPartiallyDirectedGraph, PartiallyDirectedGraph
from netloom.operators.independence import DynamicIndependenceTest, IndependenceTest
from netloom.operators.models import BayesianNetwork, BayesianNetworkType, CLGNetworkType, ConditionalBayesianNetwork, DiscreteBNType, DynamicBayesianNetwork, GaussianNetworkType, KDENetworkType, SemiparametricBNType
from netloom.operators.scores import BDe, BGe, BIC, CVLikelihood, DynamicScore, HoldoutLikelihood, Score, ValidatedLikelihood, ValidatedScore
from netloom.operators.search import ArcOperatorSet, ChangeNodeTypeSet, LocalScoreCache, OperatorPool, OperatorSet, OperatorTabuSet
from netloom.operators.temporal import temporal_name
from netloom.sources.dataset import Dataset

Arcs = Sequence[tuple[str, str]]


class Callback:
    """Called at the start and end with no operator, and after each step."""

    def call(self, model, operator, score, num_iter: int) -> None:
        raise NotImplementedError


# ---------------------------------------------------------------- restrictions


def check_restrictions(nodes: Iterable[str], arc_blacklist: Arcs, arc_whitelist: Arcs, edge_blacklist: Arcs = (), edge_whitelist: Arcs = (), interface: Iterable[str] = ()) -> tuple[set, set, set, set]:
    """Arc and edge lists as consistent sets. A blacklisted edge is two blacklisted arcs; an edge both of whose arcs are blacklisted is
    blacklisted; a whitelisted edge with one blacklisted arc is the other whitelisted arc. Contradictions raise."""
    nodes, interface = set(nodes), set(interface)
    for a, b in [*arc_blacklist, *arc_whitelist, *edge_blacklist, *edge_whitelist]:
        if not {a, b} <= nodes | interface:
            raise ValueError(f"({a}, {b}) is not in the data")
    ab, aw = set(arc_blacklist), set(arc_whitelist)
    eb, ew = {frozenset(e) for e in edge_blacklist}, {frozenset(e) for e in edge_whitelist}
    for e in eb:
        a, b = tuple(e)
        ab |= {(a, b), (b, a)}
    eb |= {frozenset(x) for x in ab if x[::-1] in ab}
    if bad := ab & aw:
        raise ValueError(f"arcs both black- and whitelisted: {sorted(bad)}")
    if bad := eb & ew:
        raise ValueError(f"edges both black- and whitelisted: {[sorted(x) for x in bad]}")
    for e in list(ew):
        a, b = tuple(e)
        for x, y in ((a, b), (b, a)):
            if (x, y) in ab:
                ew.discard(e)
                aw.add((y, x))
            if (x, y) in aw:
                ew.discard(e)
    if bad := [x for x in aw if x[::-1] in aw or x[1] in interface]:
        raise ValueError(f"impossible whitelisted arcs: {bad}")
    return ab, aw, eb, ew


# ---------------------------------------------------------------- hill climbing


class _Standing:
    """Where a climb stands: the best network so far with its total, and how far the network at hand has fallen behind it. Totals are
    relative to the start; they count held-out score changes if the score has such, else score changes."""

    def __init__(self, model: BayesianNetwork, patience: int):
        self.model = self.best = model
        self.total = self.best_total = 0.0
        self.stale, self.patience = 0, patience
        self.tabu = OperatorTabuSet()

    def offer(self, op, model: BayesianNetwork, gain: float) -> bool:
        """Take a step to `model`, unless that would be one too many without a new best."""
        record = self.total + gain > self.best_total + TOL
        if not record and self.stale == self.patience:
            return False
        self.total += gain
        if record:
            self.best, self.best_total, self.stale = model, self.total, 0
            self.tabu.clear()
        else:
            self.stale += 1
            self.tabu.insert(op.opposite(self.model))  # no way back before there is a new best
        self.model = model
        return True


class GreedyHillClimbing:
    """The best operator by score at each step. With a validated score the held-out change decides, `patience` steps without a new best are
    allowed, and their undoing is tabu meanwhile."""

    def _start(self, start: BayesianNetwork, score: Score, arc_blacklist: Arcs, arc_whitelist: Arcs, type_blacklist, type_whitelist) -> tuple[BayesianNetwork, set, set]:
        """A copy of the start that keeps to the restrictions, and the arc restrictions."""
        model = start.clone()
        if not score.has_variables(model.joint_nodes()):
            raise ValueError("the score lacks variables of the network")
        banned, forced, _, _ = check_restrictions(model.nodes(), arc_blacklist, arc_whitelist, interface=model.interface_nodes())
        model.check_blacklist(banned)
        model.force_type_whitelist(type_whitelist)
        if model.has_unknown_node_types() and (data := score.data()) is not None:
            model.set_unknown_node_types(data, type_blacklist)
        model.force_whitelist(forced)
        if not score.compatible_bn(model):
            raise ValueError("the score does not suit the network")
        return model, banned, forced

    def estimate(self, operators: OperatorSet, score: Score, start: BayesianNetwork, arc_blacklist: Arcs = (), arc_whitelist: Arcs = (), type_blacklist=(), type_whitelist=(), callback=None, max_indegree: int = 0, max_iters: int = 2**31 - 1, epsilon: float = 0.0, patience: int = 0, verbose: int = 0):
        model, banned, forced = self._start(start, score, arc_blacklist, arc_whitelist, type_blacklist, type_whitelist)
        operators.set_max_indegree(max_indegree)
        operators.set_arc_whitelist(forced)
        operators.set_arc_blacklist(banned)
        operators.set_type_whitelist(type_whitelist)
        operators.set_type_blacklist(type_blacklist)
        operators.cache_scores(model, score)
        local = operators.local_score_cache(model, score)
        held = HeldOutScores(model, score) if isinstance(score, ValidatedScore) else None
        say = callback.call if callback is not None else lambda *_: None
        at, taken = _Standing(model, patience), 0
        say(at.model, None, score, taken)
        with progress("hill climbing", max_iters, verbose) as tick:
            for op in iter(lambda: operators.find_max(at.model, None if at.tabu.empty() else at.tabu), None):
                if taken == max_iters or op.delta() < epsilon + TOL:
                    break
                after = at.model.clone()
                op.apply(after)
                touched = op.nodes_changed(after)
                if not at.offer(op, after, held.change(after, touched) if held else op.delta()):
                    break
                taken += 1
                for node in touched:
                    local.update_local_score(after, score, node)
                if held:
                    held.settle(after, touched)
                tick(str(op))
                say(after, op, score, taken)
                operators.update_scores(after, score, touched)
        operators.finished()
        say(at.best, None, score, taken)
        return at.best


class HeldOutScores:
    """Held-out local scores of a network as it stands."""

    def __init__(self, model: BayesianNetwork, score: ValidatedScore):
        self._score, self._kept = score, LocalScoreCache()
        self._kept.cache_vlocal_scores(model, score)

    def change(self, model: BayesianNetwork, nodes: Iterable[str]) -> float:
        return sum(self._score.vlocal_score(model, n) - self._kept.local_score(model, n) for n in nodes)

    def settle(self, model: BayesianNetwork, nodes: Iterable[str]) -> None:
        for n in nodes:
            self._kept.update_vlocal_score(model, self._score, n)


@contextmanager
def progress(title: str, total: int, verbose: int):
    """A function to call at each step. With `verbose` it keeps a line on standard error: the steps, their share of a known total, the
    seconds and what the step did; a terminal rewrites the line, a file gets one line a step."""
    begun, steps, last = time.monotonic(), 0, ""
    known = 0 < total < 2**31 - 1

    def tick(text: str = "") -> None:
        nonlocal steps, last
        steps += 1
        if verbose:
            share = f" {min(steps, total)}/{total} [{'#' * (20 * min(steps, total) // total):<20}]" if known else f" {steps}"
            last = f"{title}:{share} {time.monotonic() - begun:.1f} s {text}"
            print(f"\r{last:<100}" if sys.stderr.isatty() else last, end="" if sys.stderr.isatty() else "\n", file=sys.stderr, flush=True)

    try:
        yield tick
    finally:
        if verbose and last and sys.stderr.isatty():
            print(file=sys.stderr)


def default_score(bn_type: BayesianNetworkType) -> str:
    if isinstance(bn_type, (SemiparametricBNType, KDENetworkType)):
        return "validated-lik"
    if isinstance(bn_type, (GaussianNetworkType, DiscreteBNType, CLGNetworkType)):
        return "bic"
    raise ValueError(f"{bn_type} has no default score")


def make_score(name: str, data: Dataset, seed: int | None, num_folds: int, test_ratio: float, args: Arguments | None = None, key=None) -> Score:
    kinds = {
        "bic": lambda: BIC(data), "bge": lambda: BGe(data), "bde": lambda: BDe(data), "cv-lik": lambda: CVLikelihood(data, num_folds, seed, args, key),
        "holdout-lik": lambda: HoldoutLikelihood(data, test_ratio, seed, args, key), "validated-lik": lambda: ValidatedLikelihood(data, test_ratio, num_folds, seed, args, key),
    }
    if name not in kinds:
        raise ValueError(f"scores are {sorted(kinds)}")
    return kinds[name]()


def make_operators(names: Sequence[str], bn_type: BayesianNetworkType, arc_blacklist, arc_whitelist, max_indegree, type_blacklist, type_whitelist) -> OperatorSet:
    kinds = {"arcs": lambda: ArcOperatorSet(arc_blacklist, arc_whitelist, max_indegree), "node_type": lambda: ChangeNodeTypeSet(type_blacklist, type_whitelist)}
    if unknown := [n for n in names if n not in kinds]:
        raise ValueError(f"no operators {unknown}")
    made = [kinds[n]() for n in names]
    return made[0] if len(made) == 1 else OperatorPool(made)


def hc(data, bn_type: BayesianNetworkType | None = None, start: BayesianNetwork | None = None, score: str | Score | None = None, operators: Sequence[str] | None = None, arc_blacklist: Arcs = (), arc_whitelist: Arcs = (), type_blacklist=(), type_whitelist=(), callback=None, max_indegree: int = 0, max_iters: int = 2**31 - 1, epsilon: float = 0.0, patience: int = 0, seed: int | None = None, num_folds: int = 10, test_holdout_ratio: float = 0.2, verbose: int = 0, key: Sequence[str] | None = None):
    """Hill climbing with defaults by network type. max_iters 0 is no limit."""
    data = Dataset.of(data)
    if bn_type is None:
        if start is None:
            raise ValueError("give bn_type or start")
        bn_type = start.type()
    made = score if isinstance(score, Score) else make_score(score or default_score(bn_type), data, seed, num_folds, test_holdout_ratio, key=key)
    names = operators or (["arcs", "node_type"] if isinstance(bn_type, SemiparametricBNType) else ["arcs"])
    start = start if start is not None else bn_type.new_bn([c for c in data.columns if not key or c not in key])
    ops = make_operators(names, bn_type, arc_blacklist, arc_whitelist, max_indegree, type_blacklist, type_whitelist)
    return GreedyHillClimbing().estimate(ops, made, start, arc_blacklist, arc_whitelist, type_blacklist, type_whitelist, callback, max_indegree, max_iters or 2**31 - 1, epsilon, patience, verbose)


# ---------------------------------------------------------------- PC


def _check_alpha(alpha: float, threshold: float) -> None:
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    if not 0 <= threshold <= 1:
        raise ValueError("the ambiguity threshold must be between 0 and 1")


def _separates(test: IndependenceTest, triples: Sequence[tuple[str, str, list[str]]], alpha: float):
    """Whether z separates x and y, for tests that are done together beforehand."""
    known = {(frozenset((x, y)), frozenset(z)): p > alpha for (x, y, z), p in zip(triples, test.pvalues(triples) if triples else [], strict=True)}
    return lambda x, y, z: known[frozenset((x, y)), frozenset(z)]


class PC:
    """PC-stable. Each level's tests go to the test object at once."""

    def estimate(self, hypot_test: IndependenceTest, nodes: Sequence[str] = (), arc_blacklist: Arcs = (), arc_whitelist: Arcs = (), edge_blacklist: Arcs = (), edge_whitelist: Arcs = (), alpha: float = 0.05, use_sepsets: bool = False, ambiguous_threshold: float = 0.5, allow_bidirected: bool = True, verbose: int = 0) -> PartiallyDirectedGraph:
        _check_alpha(alpha, ambiguous_threshold)
        names = list(nodes) or hypot_test.variable_names()
        return self._run(hypot_test, PartiallyDirectedGraph.CompleteUndirected(names), arc_blacklist, arc_whitelist, edge_blacklist, edge_whitelist, alpha, use_sepsets, ambiguous_threshold, allow_bidirected)

    def estimate_conditional(self, hypot_test: IndependenceTest, nodes: Sequence[str], interface_nodes: Sequence[str] = (), arc_blacklist: Arcs = (), arc_whitelist: Arcs = (), edge_blacklist: Arcs = (), edge_whitelist: Arcs = (), alpha: float = 0.05, use_sepsets: bool = False, ambiguous_threshold: float = 0.5, allow_bidirected: bool = True, verbose: int = 0) -> ConditionalPartiallyDirectedGraph:
        _check_alpha(alpha, ambiguous_threshold)
        g = ConditionalPartiallyDirectedGraph.CompleteUndirected(list(nodes), list(interface_nodes))
        return self._run(hypot_test, g, arc_blacklist, arc_whitelist, edge_blacklist, edge_whitelist, alpha, use_sepsets, ambiguous_threshold, allow_bidirected)

    def _run(self, test, g, ab, aw, eb, ew, alpha, use_sepsets, threshold, allow_bidirected):
        if not test.has_variables(g.joint_nodes()):
            raise ValueError("the test lacks variables")
        ab, aw, eb, ew = check_restrictions(g.nodes(), ab, aw, eb, ew, g.interface_nodes())
        for e in eb:
            g.remove_edge(*e)
        for a, b in aw:
            g.direct(a, b)
        sepsets = self._skeleton(test, g, alpha, ew)
        g.direct_interface_edges() if g.conditional else None
        for a, b in ab:
            if g.has_edge(a, b):
                g.direct(b, a)
        used = sepsets if use_sepsets else None
        separates = _separates(test, v_structure_tests(g, used), alpha)
        self.sepsets = sepsets
        direct_v_structures(g, separates, used, threshold, allow_bidirected, aw)
        MeekRules.close(g)
        return g

    def sepset_rows(self) -> list[tuple[str, str, list[str], float]]:
        """(a, b, separating set, p) of the last estimate."""
        return sorted((*sorted(k), sorted(z), p) for k, (z, p) in self.sepsets.items())

    @staticmethod
    def _skeleton(test, g, alpha: float, whitelist: set) -> SepSets:
        sepsets = SepSets()
        free = lambda: [(a, b) for a, b in g.edges() if frozenset((a, b)) not in whitelist]
        pairs = free()
        for (a, b), p in zip(pairs, test.pvalues([(a, b, []) for a, b in pairs]), strict=True):
            if p > alpha:
                g.remove_edge(a, b)
                sepsets.put(a, b, (), p)
        level = 1
        while any(len(adjacency(g, n)) > level for n in g.nodes()):
            pairs, ask = free(), []
            for a, b in pairs:
                u, v = ([x for x in candidates(g, s) if x != t] for s, t in ((a, b), (b, a)))
                if level == 1:
                    sets = [(z,) for z in dict.fromkeys([*u, *v])]
                else:
                    sets = list(combinations_of_two_sets(u if len(u) >= level else [], v if len(v) >= level else [], level))
                ask.append([(a, b, list(z)) for z in sets])
            # a pair's tests stop at the first that separates; rounds of one test for each pair keep the batches wide
            pending = {i: 0 for i, t in enumerate(ask) if t}
            width = 8
            while pending:
                batch = [(i, k) for i, at in pending.items() for k in range(at, min(at + width, len(ask[i])))]
                values = dict(zip(batch, test.pvalues([ask[i][k] for i, k in batch]), strict=True))
                for i in list(pending):
                    at = pending[i]
                    for k in range(at, min(at + width, len(ask[i]))):
                        if values[i, k] > alpha:
                            sepsets.put(*pairs[i], ask[i][k][2], values[i, k])
                            del pending[i]
                            break
                    else:
                        pending[i] = at + width
                        if pending[i] >= len(ask[i]):
                            del pending[i]
            for a, b in pairs:
                if sepsets.of(a, b) is not None:
                    g.remove_edge(a, b)
            level += 1
        return sepsets


# ---------------------------------------------------------------- MMPC


class MMPC:
    """Max-min parents and children; an edge needs both ends to hold each other."""

    def estimate(self, hypot_test: IndependenceTest, nodes: Sequence[str] = (), arc_blacklist: Arcs = (), arc_whitelist: Arcs = (), edge_blacklist: Arcs = (), edge_whitelist: Arcs = (), alpha: float = 0.05, ambiguous_threshold: float = 0.5, allow_bidirected: bool = True, verbose: int = 0) -> PartiallyDirectedGraph:
        _check_alpha(alpha, ambiguous_threshold)
        return self._run(hypot_test, PartiallyDirectedGraph(list(nodes) or hypot_test.variable_names()), arc_blacklist, arc_whitelist, edge_blacklist, edge_whitelist, alpha, ambiguous_threshold, allow_bidirected)

    def estimate_conditional(self, hypot_test: IndependenceTest, nodes: Sequence[str], interface_nodes: Sequence[str] = (), arc_blacklist: Arcs = (), arc_whitelist: Arcs = (), edge_blacklist: Arcs = (), edge_whitelist: Arcs = (), alpha: float = 0.05, ambiguous_threshold: float = 0.5, allow_bidirected: bool = True, verbose: int = 0):
        _check_alpha(alpha, ambiguous_threshold)
        g = ConditionalPartiallyDirectedGraph(list(nodes), list(interface_nodes))
        return self._run(hypot_test, g, arc_blacklist, arc_whitelist, edge_blacklist, edge_whitelist, alpha, ambiguous_threshold, allow_bidirected)

    def _run(self, test, g, ab, aw, eb, ew, alpha, threshold, allow_bidirected):
        ab, aw, eb, ew = check_restrictions(g.nodes(), ab, aw, eb, ew, g.interface_nodes())
        sure = {frozenset(a) for a in aw} | ew
        found = candidate_sets(test, g.nodes(), g.interface_nodes(), sure, eb, alpha)
        for a, b in itertools.combinations(g.joint_nodes(), 2):
            if g.is_interface(a) and g.is_interface(b):
                continue
            if frozenset((a, b)) in sure or b in found.get(a, ()) and a in found.get(b, ()):
                g.add_edge(a, b)
        for a, b in aw:
            g.direct(a, b)
        if g.conditional:
            g.direct_interface_edges()
        for a, b in ab:
            if g.has_edge(a, b):
                g.direct(b, a)
        direct_v_structures(g, _separates(test, v_structure_tests(g, None), alpha), None, threshold, allow_bidirected, aw)
        MeekRules.close(g)
        return g


def candidate_sets(test: IndependenceTest, nodes: Sequence[str], interface: Sequence[str], sure: set, banned: set, alpha: float) -> dict[str, list[str]]:
    """Each node's candidate parents and children: forward by max-min association, then backward pruning. All nodes take their steps side by
    side, so that a step's tests go to the test object at once."""
    every = [*nodes, *interface]
    inter = set(interface)
    pairs = [(a, b) for a, b in itertools.combinations(every, 2) if not (a in inter and b in inter) and frozenset((a, b)) not in banned]
    marginal: dict[frozenset, float] = {frozenset(p): v for p, v in zip(pairs, test.pvalues([(a, b, []) for a, b in pairs]), strict=True)}
    known: dict = {(k, frozenset()): v for k, v in marginal.items()}

    def ask(wanted: Iterable[tuple[str, str, Sequence[str]]]) -> None:
        new = {}
        for x, y, z in wanted:
            k = (frozenset((x, y)), frozenset(z))
            if k not in known:
                new.setdefault(k, (x, y, list(z)))
        if new:
            known.update(zip(new, test.pvalues(list(new.values())), strict=True))

    def p(x: str, y: str, z: Sequence[str]) -> float:
        return known[frozenset((x, y)), frozenset(z)]

    cpc, fixed, worst = {}, {}, {}
    for x in every:
        fixed[x] = [y for y in every if frozenset((x, y)) in sure]
        cpc[x] = list(fixed[x])
        near = {y: marginal[frozenset((x, y))] for y in every if y != x and frozenset((x, y)) in marginal and y not in fixed[x]}
        worst[x] = {y: v for y, v in near.items() if not v >= alpha}

    def step(moves: dict[str, tuple[list[str], str]]) -> None:
        """The association of each candidate of x: the largest p over subsets of `before` with `last`."""
        sets = {x: [[*z, last] for k in range(len(before) + 1) for z in itertools.combinations(before, k)] for x, (before, last) in moves.items()}
        ask((x, y, z) for x in moves for y in worst[x] for z in sets[x])
        for x in moves:
            for y in worst[x]:
                worst[x][y] = max([worst[x][y], *[p(x, y, z) for z in sets[x]]])

    for k in range(max(map(len, fixed.values()), default=0)):
        step({x: (f[:k], f[k]) for x, f in fixed.items() if k < len(f)})
    worst = {x: {y: v for y, v in w.items() if not v > alpha} for x, w in worst.items()}
    active = [x for x in every if worst[x]]
    while active:
        moves = {}
        for x in active:
            y = min(worst[x], key=lambda v: (worst[x][v], every.index(v)))  # noqa: B023
            if worst[x][y] < alpha or math.isnan(worst[x][y]):
                del worst[x][y]
                moves[x] = (list(cpc[x]), y)
                cpc[x].append(y)
        step(moves)
        for x in moves:
            worst[x] = {v: a for v, a in worst[x].items() if not a > alpha}
        active = [x for x in moves if worst[x]]
    todo = {x: [v for v in cpc[x] if v not in fixed[x]] for x in every}
    for i in range(max(map(len, todo.values()), default=0)):
        rest = {x: [v for v in cpc[x] if v != t[i]] for x, t in todo.items() if i < len(t)}
        for k in range(max(map(len, rest.values()), default=0) + 1):
            sets = {x: list(itertools.combinations(r, k)) for x, r in rest.items() if k <= len(r)}
            ask((x, todo[x][i], z) for x in sets for z in sets[x])
            for x in sets:
                if any(p(x, todo[x][i], z) > alpha for z in sets[x]):
                    cpc[x].remove(todo[x][i])
                    del rest[x]
    return cpc


# ---------------------------------------------------------------- MMHC, DMMHC


def _outside(found: dict[str, list[str]], nodes: Sequence[str], interface: Sequence[str]) -> set[tuple[str, str]]:
    every = [*nodes, *interface]
    return {(a, b) for a in every for b in nodes if a != b and not (b in found.get(a, ()) and a in found.get(b, ()))}


class MMHC:
    """Hill climbing over the arcs that MMPC's symmetric sets allow."""

    def estimate(self, hypot_test: IndependenceTest, operators: OperatorSet, score: Score, nodes: Sequence[str] = (), bn_type: BayesianNetworkType | None = None, arc_blacklist: Arcs = (), arc_whitelist: Arcs = (), edge_blacklist: Arcs = (), edge_whitelist: Arcs = (), type_blacklist=(), type_whitelist=(), callback=None, max_indegree: int = 0, max_iters: int = 2**31 - 1, epsilon: float = 0.0, patience: int = 0, alpha: float = 0.05, verbose: int = 0):
        _check_alpha(alpha, 0.5)
        names = list(nodes) or hypot_test.variable_names()
        start = (bn_type or GaussianNetworkType()).new_bn(names)
        return self._run(hypot_test, operators, score, start, names, [], arc_blacklist, arc_whitelist, edge_blacklist, edge_whitelist, type_blacklist, type_whitelist, callback, max_indegree, max_iters, epsilon, patience, alpha, verbose)

    def estimate_conditional(self, hypot_test: IndependenceTest, operators: OperatorSet, score: Score, nodes: Sequence[str], interface_nodes: Sequence[str] = (), bn_type: BayesianNetworkType | None = None, arc_blacklist: Arcs = (), arc_whitelist: Arcs = (), edge_blacklist: Arcs = (), edge_whitelist: Arcs = (), type_blacklist=(), type_whitelist=(), callback=None, max_indegree: int = 0, max_iters: int = 2**31 - 1, epsilon: float = 0.0, patience: int = 0, alpha: float = 0.05, verbose: int = 0) -> ConditionalBayesianNetwork:
        _check_alpha(alpha, 0.5)
        start = (bn_type or GaussianNetworkType()).new_cbn(list(nodes), list(interface_nodes))
        return self._run(hypot_test, operators, score, start, list(nodes), list(interface_nodes), arc_blacklist, arc_whitelist, edge_blacklist, edge_whitelist, type_blacklist, type_whitelist, callback, max_indegree, max_iters, epsilon, patience, alpha, verbose)

    @staticmethod
    def _run(test, operators, score, start, nodes, interface, ab, aw, eb, ew, tb, tw, callback, max_indegree, max_iters, epsilon, patience, alpha, verbose):
        ab, aw, eb, ew = check_restrictions(nodes, ab, aw, eb, ew, interface)
        sure = {frozenset(a) for a in aw} | ew
        found = candidate_sets(test, nodes, interface, sure, eb, alpha)
        banned = (ab | _outside(found, nodes, interface)) - aw
        return GreedyHillClimbing().estimate(operators, score, start, sorted(banned), sorted(aw), tb, tw, callback, max_indegree, max_iters, epsilon, patience, verbose)


class DMMHC:
    """MMHC on the static slices, where arcs go from older to newer ones only, then a conditional MMHC for the present."""

    def estimate(self, hypot_test: DynamicIndependenceTest, operators: OperatorSet, score: DynamicScore, variables: Sequence[str] = (), bn_type: BayesianNetworkType | None = None, markovian_order: int = 1, static_callback=None, transition_callback=None, max_indegree: int = 0, max_iters: int = 2**31 - 1, epsilon: float = 0.0, patience: int = 0, alpha: float = 0.05, verbose: int = 0) -> DynamicBayesianNetwork:
        bn_type = bn_type or GaussianNetworkType()
        names = list(variables) or hypot_test.variable_names()
        past = [temporal_name(v, k) for v in names for k in range(1, markovian_order + 1)]
        now = [temporal_name(v, 0) for v in names]
        backward = [(temporal_name(a, i), temporal_name(b, j)) for a in names for b in names for i in range(1, markovian_order + 1) for j in range(1, markovian_order + 1) if i < j]
        static = MMHC().estimate(hypot_test.static_tests(), operators, score.static_score(), past, bn_type, arc_blacklist=backward, callback=static_callback, max_indegree=max_indegree, max_iters=max_iters, epsilon=epsilon, patience=patience, alpha=alpha, verbose=verbose)
        transition = MMHC().estimate_conditional(hypot_test.transition_tests(), operators, score.transition_score(), now, past, bn_type, callback=transition_callback, max_indegree=max_indegree, max_iters=max_iters, epsilon=epsilon, patience=patience, alpha=alpha, verbose=verbose)
        return DynamicBayesianNetwork(bn_type, names, markovian_order, static, transition)


