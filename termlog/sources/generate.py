"""Programs as text: a domain and a model of random facts, for tests and benchmarks of the parser and the engine."""

from __future__ import annotations

import random

from ..lang.ast import Expr
from ..types import canonical
from .tables import record


def graph_program(domain: str, types: str, nodes: int, edges: int, seed: int = 0) -> str:
    """`domain` with the given types and rules, and model `<domain>_facts` with `edges` distinct Edge facts over Node(0) to
    Node(nodes - 1). The text is made on the driver, so it is for small models; random_graph() makes tables of any size."""
    if edges > nodes * nodes:
        raise ValueError(f"{nodes} nodes have {nodes * nodes} edges at most")
    drawn = sorted(random.Random(seed).sample(range(nodes * nodes), edges))
    facts: list[Expr] = [record({"Node": i}) for i in range(nodes)]
    facts += [record({"Edge": [{"Node": x // nodes}, {"Node": x % nodes}]}) for x in drawn]
    lines = "\n".join(f"  {canonical(f)}." for f in facts)
    return f"domain {domain} {{ {types} }}\nmodel {domain}_facts of {domain} {{\n{lines}\n}}\n"
