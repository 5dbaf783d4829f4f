"""Syntax trees of programs. All nodes are immutable values; equality is structural."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    """A variable, `root.fragment.fragment`; `_` is a don't-care."""

    root: str
    fragments: tuple[str, ...] = ()

    def __str__(self) -> str:
        return ".".join((self.root, *self.fragments))


@dataclass(frozen=True)
class Lit:
    value: int | float | str | bool

    def __str__(self) -> str:
        return f'"{self.value}"' if isinstance(self.value, str) else str(self.value).lower() if isinstance(self.value, bool) else str(self.value)


@dataclass(frozen=True)
class Param:
    """`%name`: a transform's parameter."""

    name: str

    def __str__(self) -> str:
        return f"%{self.name}"


@dataclass(frozen=True)
class Term:
    """A constructor with arguments; none for a constant."""

    name: str
    args: tuple[Expr, ...] = ()

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})" if self.args else self.name


@dataclass(frozen=True)
class Unary:
    op: str
    of: Expr

    def __str__(self) -> str:
        return f"{self.op}{self.of}"


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Compre:
    """op(args..., { heads | body }): count, sum, minAll, maxAll, topK, bottomK, toOrdinal."""

    op: str
    args: tuple[Expr, ...]
    heads: tuple[Expr, ...]
    body: tuple[Constraint, ...]

    def __str__(self) -> str:
        inside = f"{{ {', '.join(map(str, self.heads))} | {', '.join(map(str, self.body))} }}"
        return f"{self.op}({', '.join([*map(str, self.args), inside])})"


Expr = Var | Lit | Param | Term | Unary | Binary | Compre


@dataclass(frozen=True)
class Pred:
    """A pattern over a relation, with an alias or negated or both."""

    term: Term
    alias: str | None = None
    negated: bool = False

    def __str__(self) -> str:
        return ("no " if self.negated else "") + (f"{self.alias} is " if self.alias else "") + str(self.term)


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class HasType:
    """x : T, or x is T."""

    var: Var
    type: str
    scan: bool = False
    negated: bool = False

    def __str__(self) -> str:
        return ("no " if self.negated else "") + f"{self.var} {'is' if self.scan else ':'} {self.type}"


@dataclass(frozen=True)
class NoSet:
    """no { heads | body }: true where the set is empty."""

    compre: Compre

    def __str__(self) -> str:
        return f"no {self.compre}"


Constraint = Pred | Compare | HasType | NoSet


@dataclass(frozen=True)
class Rule:
    """heads :- body; a fact without a body; a conformance rule without heads."""

    heads: tuple[Term, ...]
    body: tuple[Constraint, ...] = ()

    def __str__(self) -> str:
        return (", ".join(map(str, self.heads)) or "conforms") + (f" :- {', '.join(map(str, self.body))}" if self.body else "") + "."


@dataclass(frozen=True)
class TypeRef:
    name: str


@dataclass(frozen=True)
class EnumDef:
    """{2, "hi", NIL} and {0..100}: values, nullary constants, ranges as pairs."""

    values: tuple[int | float | str | bool, ...] = ()
    constants: tuple[str, ...] = ()
    ranges: tuple[tuple[int, int], ...] = ()


@dataclass(frozen=True)
class UnionDef:
    members: tuple[TypeRef | EnumDef, ...]


@dataclass(frozen=True)
class FieldDef:
    name: str | None
    type: TypeRef | EnumDef | UnionDef


@dataclass(frozen=True)
class CompositeDef:
    fields: tuple[FieldDef, ...]
    bijection: int = 0  # fields before =>, if the constructor is one-to-one between both sides


@dataclass(frozen=True)
class TypeDef:
    name: str
    definition: CompositeDef | UnionDef | EnumDef | TypeRef


@dataclass(frozen=True)
class Require:
    """requires atleast 5 E."""

    kind: str
    n: int
    type: str


@dataclass(frozen=True)
class Inherit:
    mode: str  # extends, includes, of or in
    name: str
    scope: str | None = None


@dataclass(frozen=True)
class Fact:
    term: Term
    alias: str | None = None


@dataclass
class Module:
    kind: str  # domain, model, transform
    name: str
    inherits: list[Inherit] = field(default_factory=list)
    types: list[TypeDef] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    conforms: list[tuple[Constraint, ...]] = field(default_factory=list)
    requires: list[Require] = field(default_factory=list)
    facts: list[Fact] = field(default_factory=list)
    params: list[FieldDef] = field(default_factory=list)
    inputs: list[Inherit] = field(default_factory=list)
    outputs: list[Inherit] = field(default_factory=list)


@dataclass(frozen=True)
class Apply:
    """result = Transform(args): the arguments are literals or model names."""

    result: str
    transform: str
    args: tuple[Lit | str, ...]


@dataclass
class Program:
    modules: dict[str, Module] = field(default_factory=dict)
    applications: list[Apply] = field(default_factory=list)
