"""Which of many patterns, and which of their alternatives, can match a text at all, in one pass over it.

From each expression the literals are read of which every match must contain one. All literals of all patterns go
into one Aho-Corasick automaton, built once per Python worker; a text is run through it once, and only the
patterns whose literals occur are evaluated afterwards. Patterns without such literals always count as possible, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:     # every pattern counts as possible then
    ahocorasick = None


def required(expression: str) -> frozenset[str] | None:
    """Lower-cased literals of which every match contains at least one; None if there are none."""
    import re
    try:
        from re import _parser as parser
    except ImportError:
        import sre_parse as parser
    try:
        parsed = parser.parse(expression)
    except (re.error, OverflowError):
        return None
    found = _of_sequence(parsed)
    return found or None


def _of_sequence(items) -> frozenset[str] | None:
    """The most telling of what the parts of a sequence require: the one whose shortest literal is longest."""
    best, run = None, ""

    def offer(candidate):
        nonlocal best
        if candidate and (best is None or min(map(len, candidate)) > min(map(len, best))):
            best = candidate
    for op, value in items:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            if name != "AT":
                offer(frozenset([run]) if run else None)
                run = ""
            continue            # a border between letters does not end a literal
        offer(frozenset([run]) if run else None)
        run = ""
        if name == "SUBPATTERN":
            offer(_of_sequence(value[-1]))
        elif name == "BRANCH":
            branches = [_of_sequence(b) for b in value[1]]
            offer(frozenset().union(*branches) if all(branches) else None)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            offer(_of_sequence(value[2]))
        elif name == "ATOMIC_GROUP":
            offer(_of_sequence(value))
    offer(frozenset([run]) if run else None)
    return best


@lru_cache(maxsize=16)
def _automaton(expressions: tuple[str, ...]):
    """(automaton with the patterns of each literal, patterns that are always possible)."""
    of, always = {}, []
    for place, expression in enumerate(expressions):
        literals = required(expression)
        if literals is None:
            always.append(place)
        for literal in literals or ():
            of.setdefault(literal, []).append(place)
    machine = ahocorasick.Automaton()
    for literal, places in of.items():
        machine.add_word(literal, tuple(places))
    if of:
        machine.make_automaton()
    return (machine if of else None), always


def possible(text: Column, expressions: Sequence[str]) -> Column:
    """Places (array of int) of the expressions that can match ``text``, letters compared in any case."""
    if ahocorasick is None:
        return F.when(text.isNotNull(), F.sequence(F.lit(0), F.lit(len(expressions) - 1)))
    wanted = tuple(expressions)

    @F.arrow_udf("array<int>")
    def places(texts: pa.Array) -> pa.Array:
        machine, always = _automaton(wanted)
        out = []
        for value in texts:
            t = value.as_py()
            if t is None:
                out.append(None)
                continue
            hit = set(always)
            for _, found in machine.iter(t.lower()) if machine else ():
                hit.update(found)
            out.append(sorted(hit))
        return pa.array(out, pa.list_(pa.int32()))
    return places(text)


@lru_cache(maxsize=16)
def _literals(alternatives: tuple[str, ...]):
    """(automaton over the literals, the places of the alternatives that ask for each literal)."""
    of = {}
    for place, expression in enumerate(alternatives):
        for literal in required(expression) or ():
            of.setdefault(literal, []).append(place)
    machine = ahocorasick.Automaton()
    for number, literal in enumerate(of):
        machine.add_word(literal, number)
    if of:
        machine.make_automaton()
    return (machine if of else None), list(of.values())


def possible_alternatives(text: Column, patterns: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """For each pattern (flags, alternatives) an expression of those alternatives whose literals occur in ``text``, null if there are none.

    Alternatives without required literals are not among them: they can match any text. Long texts hold some literal of most
    patterns, so what is run on a text must follow its literals and not its patterns.
    """
    wanted = tuple((flags, tuple(alternatives)) for flags, alternatives in patterns)
    every = tuple(a for _, alternatives in wanted for a in alternatives)
    owner = [i for i, (_, alternatives) in enumerate(wanted) for _ in alternatives]

    def expressions(places) -> list[str | None]:
        chosen: list[list[str]] = [[] for _ in wanted]
        for place in sorted(places):
            chosen[owner[place]].append(every[place])
        return [f"{flags}(?:{'|'.join(x)})" if x else None for (flags, _), x in zip(wanted, chosen)]

    if ahocorasick is None:
        return F.when(text.isNotNull(), F.array(*[F.lit(x) for x in expressions([i for i, a in enumerate(every) if required(a)])]))

    @F.arrow_udf("array<string>")
    def chosen(texts: pa.Array) -> pa.Array:
        machine, asking = _literals(every)
        out = []
        for value in texts:
            t = value.as_py()
            if t is None:
                out.append(None)
                continue
            found = {number for _, number in machine.iter(t.lower())} if machine else ()
            out.append(expressions({place for number in found for place in asking[number]}))
        return pa.array(out, pa.list_(pa.string()))
    return chosen(text)
