"""Commands over programs: python -m termlog "load FILE | solve m | query m Path(a, b) | apply r = Del(1, m) | rules D".

Commands are parted by `|` outside braces, parentheses and quotes, or by lines; without an argument they are read from
standard input."""

from __future__ import annotations

import sys
from pathlib import Path

from .lang.ast import Lit
from .lang.parser import Parser
from .modules import Engine


def split_commands(text: str) -> list[str]:
    out, now, depth, quoted = [], "", 0, False
    for c in text:
        quoted ^= c == '"'
        depth += 0 if quoted else (c in "{(") - (c in "})")
        if not quoted and (c == "|" and depth <= 0 or c == "\n"):
            out.append(now)
            now, depth = "", 0
        else:
            now += c
    return [x.strip() for x in [*out, now] if x.strip()]


def execute(engine: Engine, command: str, write=print) -> None:
    verb, _, rest = command.strip().partition(" ")
    rest = rest.strip()
    if verb in ("load", "l"):
        engine.load(Path(rest).read_text())
    elif verb == "solve":
        r = engine.solve(rest)
        for name in sorted(r.relations.known):
            for row in r.text(name).toLocalIterator():
                write(row.term)
    elif verb in ("query", "qr"):
        model, _, body = rest.partition(" ")
        for row in engine.solve(model).query(body).toLocalIterator():
            write(", ".join(f"{k} = {v}" for k, v in row.asDict().items()))
    elif verb == "conforms":
        for row in engine.solve(rest).conformance().collect():
            write(f"{row.holds}: {row.rule}")
    elif verb in ("apply", "ap"):
        a = Parser(rest).application()
        for scope, r in engine.apply(a.result, a.transform, *(x if isinstance(x, Lit) else str(x) for x in a.args)).items():
            write(f"{a.result} is {scope} of {a.transform}: {', '.join(sorted(r.relations.known))}")
    elif verb == "rules":
        write(engine.domain(rest).explain())
    elif verb == "plans":
        write(engine.solve(rest).explain())
    elif verb:
        raise ValueError(f"unknown command {verb!r}")


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("termlog").getOrCreate()
    engine = Engine(spark)
    text = " ".join(sys.argv[1:]) if len(sys.argv) > 1 else sys.stdin.read()
    for command in split_commands(text):
        execute(engine, command)


if __name__ == "__main__":
    main()
