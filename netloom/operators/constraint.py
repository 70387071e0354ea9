"""Orientation of partially directed graphs: rules, v-structures, and the bookkeeping of separating sets."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence


class MeekRules:
    """Each rule directs what it can and tells whether anything changed."""

    @staticmethod
    def rule1(g) -> bool:
        """a -> b - c with a and c apart: b -> c."""
        changed = False
        for b in g.joint_nodes():
            for a in g.parents(b):
                if g.has_arc(b, a):
                    continue
                for c in g.neighbors(b):
                    if g.has_edge(b, c) and not g.is_interface(c) and not g.has_connection(a, c):
                        g.direct(b, c)
                        changed = True
        return changed

    @staticmethod
    def rule2(g) -> bool:
        """a -> b -> c with a - c: a -> c."""
        changed = False
        for a, c in [p for e in g.edges() for p in (e, e[::-1])]:
            if g.has_edge(a, c) and not g.is_interface(c) and any(g.has_arc(b, c) and not g.has_arc(c, b) and not g.has_arc(b, a) for b in g.children(a)):
                g.direct(a, c)
                changed = True
        return changed

    @staticmethod
    def rule3(g) -> bool:
        """a - b, a - c, a - d, b -> d, c -> d with b and c apart: a -> d."""
        changed = False
        for a, d in [p for e in g.edges() for p in (e, e[::-1])]:
            if g.has_edge(a, d) and not g.is_interface(d):
                mid = [b for b in g.neighbors(a) if g.has_arc(b, d) and not g.has_arc(d, b)]
                if any(not g.has_connection(b, c) for b, c in itertools.combinations(mid, 2)):
                    g.direct(a, d)
                    changed = True
        return changed

    @classmethod
    def close(cls, g) -> None:
        while any([cls.rule1(g), cls.rule2(g), cls.rule3(g)]):
            pass


class SepSets(dict):
    """Separating set and p-value by unordered pair."""

    def put(self, a: str, b: str, z: Iterable[str], p: float) -> None:
        self[frozenset((a, b))] = (frozenset(z), p)

    def of(self, a: str, b: str):
        return self.get(frozenset((a, b)))


def combinations_of_two_sets(left: Sequence[str], right: Sequence[str], k: int) -> Iterator[tuple[str, ...]]:
    """k-subsets of either set, each once."""
    seen = set()
    for s in (left, right):
        for c in itertools.combinations(s, k):
            if (key := frozenset(c)) not in seen:
                seen.add(key)
                yield c


def all_subsets(items: Sequence[str], low: int, high: int, fixed: Sequence[str] = ()) -> Iterator[tuple[str, ...]]:
    """Subsets of sizes low..high that hold `fixed`."""
    rest = [x for x in items if x not in fixed]
    for k in range(max(0, low - len(fixed)), min(len(rest), high - len(fixed)) + 1):
        for c in itertools.combinations(rest, k):
            yield (*fixed, *c)


def adjacency(g, x: str) -> list[str]:
    return list(dict.fromkeys([*g.neighbors(x), *g.parents(x), *g.children(x)]))


def candidates(g, x: str) -> list[str]:
    """Possible members of a separating set of x: neighbours and parents."""
    return list(dict.fromkeys([*g.neighbors(x), *g.parents(x)]))


def unshielded_triples(g) -> Iterator[tuple[str, str, str]]:
    """(a, b, c): a and c touch b by an edge or arc and don't touch each other."""
    for b in g.nodes():
        near = [x for x in candidates(g, b)]
        for a, c in itertools.combinations(near, 2):
            if not g.has_connection(a, c) and not (g.is_interface(a) and g.is_interface(c)) and (g.has_edge(a, b) or g.has_edge(c, b)):
                yield a, b, c


def _asked(g, a: str, c: str) -> Iterator[tuple[str, ...]]:
    """Subsets of either end's possible separators, each once."""
    seen = set()
    for x, y in ((a, c), (c, a)):
        side = [v for v in candidates(g, x) if v != y]
        for z in all_subsets(side, 0, len(side)):
            if (key := frozenset(z)) not in seen:
                seen.add(key)
                yield z


def v_structure_tests(g, sepsets: SepSets | None) -> list[tuple[str, str, list[str]]]:
    """All tests that direct_v_structures asks for on this graph, so that they can be done together."""
    out: dict[tuple[frozenset, frozenset], tuple[str, str, list[str]]] = {}
    for a, _, c in unshielded_triples(g):
        if sepsets is None or sepsets.of(a, c) is None:
            for z in _asked(g, a, c):
                out.setdefault((frozenset((a, c)), frozenset(z)), (a, c, list(z)))
    return list(out.values())


def is_v_structure(a: str, b: str, c: str, g, separates: Callable[[str, str, tuple[str, ...]], bool], sepsets: SepSets | None, threshold: float) -> bool:
    """By the stored separating set, or by the share of separating subsets of either adjacency that hold b."""
    if sepsets is not None and (s := sepsets.of(a, c)) is not None:
        return b not in s[0]
    total = with_b = 0
    for z in _asked(g, a, c):
        if separates(a, c, z):
            total += 1
            with_b += b in z
    return total > 0 and (with_b == 0 or with_b / total < threshold)


def direct_v_structures(g, separates, sepsets: SepSets | None, threshold: float, allow_bidirected: bool, arc_whitelist: set[tuple[str, str]]) -> None:
    found = [t for t in unshielded_triples(g) if is_v_structure(*t, g, separates, sepsets, threshold)]
    for a, b, c in found:
        for x in (a, c):
            if g.has_edge(x, b):
                g.direct(x, b)
            elif g.has_arc(b, x) and not g.has_arc(x, b) and not g.is_interface(b):
                if allow_bidirected:
                    g.direct(x, b)
                elif (b, x) not in arc_whitelist:
                    g.remove_arc(b, x)
                    g.add_arc(x, b)
