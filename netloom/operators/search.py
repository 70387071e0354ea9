"""Search operators, sets of them with cached deltas, tabu lists and local score caches."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Iterable, Sequence

from netloom.operators.factors import FactorType
from netloom.operators.scores import Score

#: What of the largest delta is rounding.
TIE = 1e-9


class Operator(ABC):
    """A change of a model and the change of score that it brings. Equality ignores delta."""

    def __init__(self, delta: float):
        self._delta = delta

    def delta(self) -> float:
        return self._delta

    @abstractmethod
    def apply(self, model) -> None: ...

    @abstractmethod
    def nodes_changed(self, model) -> list[str]: ...

    def opposite(self, model) -> Operator:
        raise NotImplementedError

    def _key(self) -> tuple:
        return ()

    def __eq__(self, other) -> bool:
        return type(self) is type(other) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash((type(self).__name__, self._key()))

    def __str__(self) -> str:
        return f"{type(self).__name__}({', '.join(map(str, self._key()))}; {self._delta})"

    __repr__ = __str__


class ArcOperator(Operator):
    def __init__(self, source: str, target: str, delta: float):
        super().__init__(delta)
        self._source, self._target = source, target

    def source(self) -> str:
        return self._source

    def target(self) -> str:
        return self._target

    def _key(self):
        return self._source, self._target


class AddArc(ArcOperator):
    def apply(self, model):
        model.add_arc(self._source, self._target)

    def nodes_changed(self, model):
        return [self._target]

    def opposite(self, model):
        return RemoveArc(self._source, self._target, -self._delta)


class RemoveArc(ArcOperator):
    def apply(self, model):
        model.remove_arc(self._source, self._target)

    def nodes_changed(self, model):
        return [self._target]

    def opposite(self, model):
        return AddArc(self._source, self._target, -self._delta)


class FlipArc(ArcOperator):
    def apply(self, model):
        model.flip_arc(self._source, self._target)

    def nodes_changed(self, model):
        return [self._source, self._target]

    def opposite(self, model):
        return FlipArc(self._target, self._source, -self._delta)


class ChangeNodeType(Operator):
    def __init__(self, node: str, node_type: FactorType, delta: float):
        super().__init__(delta)
        self._node, self._node_type = node, node_type

    def node(self) -> str:
        return self._node

    def node_type(self) -> FactorType:
        return self._node_type

    def apply(self, model):
        model.set_node_type(self._node, self._node_type)

    def nodes_changed(self, model):
        return [self._node]

    def opposite(self, model):
        return ChangeNodeType(self._node, model.node_type(self._node), -self._delta)

    def _key(self):
        return self._node, self._node_type


class OperatorTabuSet:
    def __init__(self, operators: Iterable[Operator] = ()):
        self._set = set(operators)

    def insert(self, op: Operator) -> None:
        self._set.add(op)

    def contains(self, op: Operator) -> bool:
        return op in self._set

    def clear(self) -> None:
        self._set.clear()

    def empty(self) -> bool:
        return not self._set


class LocalScoreCache:
    def __init__(self, model=None):
        self._local: dict[str, float] = {}

    def cache_local_scores(self, model, score: Score) -> None:
        score.prefetch(model, [(n, model.parents(n)) for n in model.nodes()])
        self._local = {n: score.local_score(model, n) for n in model.nodes()}

    def cache_vlocal_scores(self, model, score) -> None:
        self._local = {n: score.vlocal_score(model, n) for n in model.nodes()}

    def update_local_score(self, model, score: Score, node: str) -> None:
        self._local[node] = score.local_score(model, node)

    def update_vlocal_score(self, model, score, node: str) -> None:
        self._local[node] = score.vlocal_score(model, node)

    def update_local_scores(self, model, score: Score, op: Operator) -> None:
        for n in op.nodes_changed(model):
            self.update_local_score(model, score, n)

    def update_vlocal_scores(self, model, score, op: Operator) -> None:
        for n in op.nodes_changed(model):
            self.update_vlocal_score(model, score, n)

    def local_score(self, model, node: str) -> float:
        return self._local[node]

    def sum(self) -> float:
        return sum(self._local.values())


class OperatorSet(ABC):
    """Subclass with cache_scores, find_max and update_scores."""

    def __init__(self):
        self.cache: LocalScoreCache | None = None

    @abstractmethod
    def cache_scores(self, model, score: Score) -> None: ...

    @abstractmethod
    def find_max(self, model, tabu: OperatorTabuSet | None = None) -> Operator | None: ...

    @abstractmethod
    def update_scores(self, model, score: Score, changed: Sequence[str]) -> None: ...

    def set_arc_blacklist(self, arcs) -> None: ...

    def set_arc_whitelist(self, arcs) -> None: ...

    def set_type_blacklist(self, types) -> None: ...

    def set_type_whitelist(self, types) -> None: ...

    def set_max_indegree(self, k: int) -> None: ...

    def finished(self) -> None:
        self.cache = None

    def local_score_cache(self, model, score: Score) -> LocalScoreCache:
        if self.cache is None:
            self.cache = LocalScoreCache()
            self.cache.cache_local_scores(model, score)
        return self.cache


def best(options: Iterable[Operator], tabu: OperatorTabuSet | None) -> Operator | None:
    """The largest delta; ties go to the first by kind and names."""
    top = None
    for op in options:
        if math.isnan(op.delta()) or tabu is not None and tabu.contains(op):
            continue
        if top is None or (-op.delta(), str(op._key())) < (-top.delta(), str(top._key())):
            top = op
    return top


class ArcOperatorSet(OperatorSet):
    """Adding, removing and flipping arcs. Deltas are kept by target; a change of a node's parents renews that node's."""

    def __init__(self, blacklist: Sequence[tuple[str, str]] = (), whitelist: Sequence[tuple[str, str]] = (), max_indegree: int = 0):
        super().__init__()
        self.blacklist, self.whitelist, self.max_indegree = set(blacklist), set(whitelist), max_indegree
        self._toggle: dict[tuple[str, str], float] = {}  # change of the target's local score when the arc comes or goes
        self._flip: dict[tuple[str, str], float] = {}

    def set_arc_blacklist(self, arcs):
        self.blacklist = set(arcs)

    def set_arc_whitelist(self, arcs):
        self.whitelist = set(arcs)

    def set_max_indegree(self, k):
        self.max_indegree = k

    def _sources(self, model, target: str) -> list[str]:
        return [s for s in model.joint_nodes() if s != target]

    def cache_scores(self, model, score):
        cache = self.local_score_cache(model, score)
        nodes = model.nodes()
        score.prefetch(model, [(t, self._other(model, s, t)) for t in nodes for s in self._sources(model, t)])
        self._toggle = {}
        for t in nodes:
            self._renew(model, score, cache, t)

    @staticmethod
    def _other(model, s: str, t: str) -> list[str]:
        p = model.parents(t)
        return [x for x in p if x != s] if s in p else [*p, s]

    def _possible(self, model, s: str, t: str) -> bool:
        return model.has_arc(s, t) or (s, t) not in self.blacklist and model.type().can_have_arc(model, s, t)

    def _renew(self, model, score, cache, t: str) -> None:
        now = cache.local_score(model, t)
        for s in self._sources(model, t):
            if self._possible(model, s, t):
                self._toggle[s, t] = _minus(score.local_score(model, t, self._other(model, s, t)), now)
            else:
                self._toggle.pop((s, t), None)

    def _options(self, model):
        full = lambda n: self.max_indegree > 0 and model.num_parents(n) >= self.max_indegree
        for (s, t), d in self._toggle.items():
            if model.has_arc(s, t):
                if (s, t) in self.whitelist:
                    continue
                yield RemoveArc(s, t, d)
                if not model.is_interface(s) and (t, s) not in self.blacklist and (t, s) in self._toggle and model.type().can_have_arc(model, t, s) and not full(s):
                    yield FlipArc(s, t, d + self._toggle[t, s])
            elif not model.has_arc(t, s) and not full(t):
                yield AddArc(s, t, d)

    def find_max(self, model, tabu=None):
        """The allowed operator of largest delta. Deltas that differ by rounding only are equal (both directions of an arc, under a score of
        equivalent networks) and go by their names, so that the order in which sums were added up decides nothing."""
        name = lambda o: (type(o).__name__, o._key())
        options = [o for o in self._options(model) if not math.isnan(o.delta()) and (tabu is None or not tabu.contains(o))]
        largest = max((abs(o.delta()) for o in options if math.isfinite(o.delta())), default=0.0)
        best, top = None, 0.0
        for op in sorted(options, key=lambda o: -o.delta()):
            if best is not None and op.delta() < top - TIE * largest:
                break
            s, t = op._key()
            if isinstance(op, RemoveArc) or isinstance(op, AddArc) and model.can_add_arc(s, t) or isinstance(op, FlipArc) and model.can_flip_arc(s, t):
                top, best = op.delta() if best is None else top, op if best is None or name(op) < name(best) else best
        return best

    def update_scores(self, model, score, changed):
        cache = self.local_score_cache(model, score)
        score.prefetch(model, [(t, self._other(model, s, t)) for t in changed for s in self._sources(model, t)])
        for t in changed:
            self._renew(model, score, cache, t)
        for t in model.nodes():  # arcs that became possible or impossible through a change of type
            if t not in changed:
                for s in changed:
                    if s != t and self._possible(model, s, t) != ((s, t) in self._toggle):
                        self._renew(model, score, cache, t)
                        break

    def finished(self):
        super().finished()
        self._toggle = {}


def _minus(a: float, b: float) -> float:
    """a - b, where two impossible scores are no change."""
    return 0.0 if a == b else a - b


class ChangeNodeTypeSet(OperatorSet):
    """Changing node types; whitelisted nodes keep theirs."""

    def __init__(self, type_blacklist: Sequence[tuple[str, FactorType]] = (), type_whitelist: Sequence[tuple[str, FactorType]] = ()):
        super().__init__()
        self.type_blacklist, self.type_whitelist = set(type_blacklist), dict(type_whitelist)
        self._delta: dict[str, dict[FactorType, float]] = {}

    def set_type_blacklist(self, types):
        self.type_blacklist = set(types)

    def set_type_whitelist(self, types):
        self.type_whitelist = dict(types)

    def cache_scores(self, model, score):
        if model.type().is_homogeneous():
            raise ValueError("a homogeneous network has one node type")
        self._delta = {}
        self.update_scores(model, score, model.nodes())

    def update_scores(self, model, score, changed):
        cache = self.local_score_cache(model, score)
        for n in changed:
            if n not in self.type_whitelist:
                now = cache.local_score(model, n)
                self._delta[n] = {t: _minus(score.local_score_node_type(model, t, n, model.parents(n)), now) for t in model.type().alternative_node_type(model, n) if (n, t) not in self.type_blacklist}

    def find_max(self, model, tabu=None):
        return best((ChangeNodeType(n, t, d) for n, ds in self._delta.items() for t, d in ds.items() if model.type().compatible_node_type(model, n, t)), tabu)

    def finished(self):
        super().finished()
        self._delta = {}


class OperatorPool(OperatorSet):
    """Several sets over one score cache; every list goes to every set."""

    def __init__(self, sets: Sequence[OperatorSet]):
        super().__init__()
        if not sets:
            raise ValueError("an empty pool")
        self.sets = list(sets)

    def cache_scores(self, model, score):
        cache = self.local_score_cache(model, score)
        for s in self.sets:
            s.cache = cache
            s.cache_scores(model, score)

    def find_max(self, model, tabu=None):
        found = [o for s in self.sets if (o := s.find_max(model, tabu)) is not None]
        return max(found, key=lambda o: o.delta(), default=None)

    def update_scores(self, model, score, changed):
        for s in self.sets:
            s.cache = self.cache
            s.update_scores(model, score, changed)

    def set_arc_blacklist(self, arcs):
        for s in self.sets:
            s.set_arc_blacklist(arcs)

    def set_arc_whitelist(self, arcs):
        for s in self.sets:
            s.set_arc_whitelist(arcs)

    def set_type_blacklist(self, types):
        for s in self.sets:
            s.set_type_blacklist(types)

    def set_type_whitelist(self, types):
        for s in self.sets:
            s.set_type_whitelist(types)

    def set_max_indegree(self, k):
        for s in self.sets:
            s.set_max_indegree(k)

    def finished(self):
        super().finished()
        for s in self.sets:
            s.finished()
