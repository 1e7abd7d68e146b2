"""Syntax trees of expressions and flows."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    """An expression: an operator name and its operands (nodes, names, literals)."""

    op: str
    args: tuple = ()

    def walk(self):
        """This node and all below it."""
        yield self
        for a in self.args:
            for x in a if isinstance(a, tuple) else (a,):
                if isinstance(x, Node):
                    yield from x.walk()
                elif isinstance(x, tuple):
                    for y in x:
                        if isinstance(y, Node):
                            yield from y.walk()

    def references(self) -> set[str]:
        """Names of the variables that the expression reads."""
        return {n.args[0] for n in self.walk() if n.op == "ref"}


@dataclass(frozen=True)
class Evaluate:
    """An expression with the one that replaces it if it fails."""

    main: Node
    failover: Node | None = None

    def references(self) -> set[str]:
        return self.main.references() | (self.failover.references() if self.failover else set())


@dataclass(frozen=True)
class Assign:
    name: str
    value: Evaluate
    mode: str = "eager"  # eager, lazy, transient


@dataclass(frozen=True)
class Composite:
    name: str
    service: str
    arguments: tuple[tuple[str, Node], ...]
    over: Node | None = None  # the documents of a batch
    whole: bool = False  # a batch that passes each element as it is
    mode: str = "eager"


@dataclass(frozen=True)
class Choice:
    conditions: tuple[tuple[str, Evaluate], ...]
    block: tuple


@dataclass(frozen=True)
class Branch:
    choices: tuple[Choice, ...]


@dataclass(frozen=True)
class Include:
    scope: str
    flow: str
    arguments: tuple[tuple[str, Evaluate], ...]
    token: Evaluate | None = None


@dataclass(frozen=True)
class Schedule:
    scope: str
    flow: str
    arguments: tuple[tuple[str, Evaluate], ...]
    delay: str | None = None
    token: Evaluate | None = None
    trace: Evaluate | None = None


@dataclass(frozen=True)
class Flow:
    name: str
    block: tuple
    config: dict = field(default_factory=dict, hash=False)
    services: dict = field(default_factory=dict, hash=False)
