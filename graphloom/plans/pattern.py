"""Patterns (motifs) and their attribute-at-a-time plans; plain Python, nothing here touches Spark.

A motif is a list of directed edges over attributes 0, 1, ... Its matches are homomorphisms: attributes may take equal values. Each edge reads a relation that it names; by default all read one, `EDGES`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property


#: The relation that edges without a name read.
EDGES = "edges"


class MotifError(ValueError):
    """The description can't be planned."""


@dataclass(frozen=True)
class Constraint:
    """The edge relation between a bound attribute and the one that is being added."""

    bound: int  #: the attribute that is already bound
    forward: bool  #: the bound attribute is the source
    prior: bool  #: the relation comes before the one the plan starts from, so it is read as of now, else as of before
    relation: str = EDGES


@dataclass(frozen=True)
class Plan:
    """How to extend the two ends of one relation to all attributes."""

    start: int  #: the relation whose rows, or changes, the plan starts from
    order: tuple[int, ...]  #: attributes in the order they are bound
    within: tuple[tuple[int, int, bool], ...]  #: other edges between the two first attributes: source, target, prior
    steps: tuple[tuple[Constraint, ...], ...]  #: constraints on each attribute that is added
    within_names: tuple[str, ...] = ()  #: the relations of the edges of `within`

    def relabelled(self) -> list[list[tuple[int, bool, bool]]]:
        """The steps with attributes numbered by their place in the order."""
        at = {a: i for i, a in enumerate(self.order)}
        return [[(at[c.bound], c.forward, c.prior) for c in step] for step in self.steps]


@dataclass(frozen=True)
class Motif:
    edges: tuple[tuple[int, int], ...]
    names: tuple[str, ...] = ()  #: the relation of each edge

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", self.names or (EDGES,) * len(self.edges))
        if len(self.names) != len(self.edges):
            raise MotifError("each edge needs the name of its relation")
        used = {a for e in self.edges for a in e}
        if not self.edges:
            raise MotifError("a motif needs an edge")
        if used != set(range(len(used))):
            raise MotifError(f"attributes must be 0 to {len(used) - 1}, without gaps; found {sorted(used)}")
        if any(a == b for a, b in self.edges):
            raise MotifError("an edge from an attribute to itself only matches loops, which graphs here don't have")
        if len(self.plan(0).order) != len(used):
            raise MotifError("the motif isn't connected")

    @classmethod
    def of(cls, *edges: tuple[int, int] | tuple[int, int, str]) -> Motif:
        """From (source, target) or (source, target, relation) for each edge."""
        return cls(tuple((int(e[0]), int(e[1])) for e in edges), tuple(e[2] if len(e) > 2 else EDGES for e in edges))

    @classmethod
    def parse(cls, description: str | list[str]) -> Motif:
        """From "k s1 d1 ... sk dk"."""
        words = description.split() if isinstance(description, str) else list(description)
        try:
            n, *numbers = map(int, words)
        except ValueError as e:
            raise MotifError(f"not a motif: {words}") from e
        if n < 1 or len(numbers) != 2 * n or min(numbers) < 0:
            raise MotifError(f"{n} edges need {2 * n} attributes; found {len(numbers)}")
        return cls(tuple(zip(numbers[::2], numbers[1::2], strict=True)))

    @classmethod
    def clique(cls, k: int) -> Motif:
        """Every attribute points to every later one."""
        return cls(tuple((a, b) for a in range(k) for b in range(a + 1, k)))

    @classmethod
    def cycle(cls, k: int) -> Motif:
        return cls(tuple((a, (a + 1) % k) for a in range(k)))

    @cached_property
    def width(self) -> int:
        return 1 + max(a for e in self.edges for a in e)

    @property
    def columns(self) -> list[str]:
        return [f"x{a}" for a in range(self.width)]

    @property
    def relations(self) -> list[str]:
        """The names of all relations, in the order of the edges."""
        return list(dict.fromkeys(self.names))

    def _order(self, start: int) -> list[int]:
        """The start's two attributes, then each time the one with the most edges to those before it (ties: the least); attributes that can't be reached are left out."""
        order = list(self.edges[start])
        touching = {a: {b for e in self.edges if a in e for b in e} - {a} for a in range(self.width)}
        while near := [a for a in touching if a not in order and touching[a] & set(order)]:
            order.append(max(near, key=lambda a: (sum(a in e and not {*e} - {a, *order} for e in self.edges), -a)))
        return order

    def reach(self) -> tuple[int, int]:
        """How many steps away from any one edge's ends the nearer end of another edge, and any attribute, can be."""
        inner = outer = 0
        for start in self.edges:
            steps, level = dict.fromkeys(start, 0), 0
            while fresh := {x for e in self.edges if steps.keys() & set(e) for x in e} - steps.keys():
                level += 1
                steps |= dict.fromkeys(fresh, level)
            inner = max(inner, *(min(steps[a], steps[b]) for a, b in self.edges))
            outer = max(outer, *steps.values())
        return inner, outer

    def plan(self, start: int) -> Plan:
        order = self._order(start)
        place = {a: i for i, a in enumerate(order)}
        steps: dict[int, list[Constraint]] = {a: [] for a in order[2:]}
        within, names = [], []
        for i, (src, dst) in enumerate(self.edges):
            if i == start or src not in place or dst not in place:
                continue
            late = max(src, dst, key=place.__getitem__)
            if place[late] < 2:
                within.append((src, dst, i < start))
                names.append(self.names[i])
            else:
                steps[late].append(Constraint(src if late == dst else dst, late == dst, i < start, self.names[i]))
        return Plan(start, tuple(order), tuple(within), tuple(tuple(steps[a]) for a in order[2:]), tuple(names))
