"""Command scripts: `start; insert Edge(Node(1), Node(0)), delete ...; commit dump_changes;`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..lang.ast import Term, Var
from ..lang.parser import ParseError, Parser


@dataclass(frozen=True)
class Command:
    verb: str  # start, insert, delete, commit, rollback, dump
    relation: str | None = None
    term: Term | None = None
    changes: bool = False


def parse_commands(text: str) -> list[Command]:
    """Statements end with `;`; updates may be joined by commas; a term may name its relation, as in Edge[...]."""
    out: list[Command] = []
    for statement in re.sub(r"#[^\n]*|//[^\n]*", "", text).split(";"):
        words = statement.split(None, 1)
        if not words:
            continue
        verb = words[0]
        if verb in ("start", "rollback"):
            out.append(Command(verb))
        elif verb == "commit":
            out.append(Command("commit", changes=len(words) > 1 and words[1].strip() == "dump_changes"))
        elif verb == "dump":
            out.append(Command("dump", relation=words[1].strip() if len(words) > 1 else None))
        elif verb in ("insert", "delete"):
            for part in re.split(r",\s*(?=(?:insert|delete)\b)", statement.strip()):
                verb, rest = part.split(None, 1)
                out.append(_update(verb, rest.strip()))
        elif verb not in ("echo", "timestamp", "exit", "profile"):
            raise ParseError(f"unknown command {verb!r}")
    return out


def _update(verb: str, text: str) -> Command:
    relation = None
    if m := re.fullmatch(r"(\w+)\s*\[(.*)\]", text, re.DOTALL):
        relation, text = m[1].removesuffix("Input"), m[2]
    elif m := re.match(r"(\w+)Input\s*\(", text):
        relation = m[1]
    term = _positional(text)
    return Command(verb, relation or term.name, term)


def _positional(text: str) -> Term:
    """A term whose fields may be named (.src = Node(1)) and whose constructors may be braced."""
    p = Parser(re.sub(r"\.\w+\s*=", "", text.replace("{", "(").replace("}", ")")))
    term = p.primary()
    if isinstance(term, Var):
        term = Term(str(term))
    if p.kind() != "end" or not isinstance(term, Term):
        raise ParseError(f"can't read the term {text!r}")
    return term
