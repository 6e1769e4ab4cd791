"""Boolean trigram queries of regular expressions.

A query is True (no trigram is mandatory) or a nested tuple ``("and", ...)``, ``("or", ...)`` or
``("tri", t)`` over lower-cased trigrams; every text that the expression matches satisfies it.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser

#: Largest set of strings that is followed exactly.
MOST = 64


def _all(items):
    flat = []
    for q in items:
        if q is True:
            continue
        flat += q[1:] if q[0] == "and" else [q]
    flat = sorted(set(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _terms(q) -> frozenset:
    return frozenset(q[1:]) if q[0] == "and" else frozenset([q])


def _any(items):
    if any(q is True for q in items):
        return True
    sets = {_terms(q) for q in items}
    sets = sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)
    parts = [_all(s) for s in sets]
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_string(s: str):
    return _all([("tri", s[i : i + 3]) for i in range(len(s) - 2)])


def _of_strings(strings):
    return _any([_of_string(s) for s in strings])


def _class(items):
    """The characters of a small class, or None."""
    out = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < MOST:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _node(op, arg):
    """(exact strings or None, query)."""
    if op is C.LITERAL:
        return {chr(arg).lower()}, True
    if op is C.IN:
        return _class(arg), True
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and len(found := set().union(*(e for e, _ in parts))) <= MOST:
            return found, True
        return None, _any([_of_strings(e) if e is not None else q for e, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = arg
        exact, q = _sequence(inner)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, True
        if least == 0:
            return None, True
        if exact is not None and len(exact) == 1 and least == most and least < 64:
            return {next(iter(exact)) * least}, True
        return None, q if exact is None else _of_strings(exact)
    if op is C.AT:
        return {""}, True
    return None, True


def _sequence(items):
    now, queries, exact = {""}, [], True
    for op, arg in items:
        strings, q = _node(op, arg)
        if strings is None:
            queries += [_of_strings(now), q]
            now, exact = {""}, False
            continue
        longer = {a + b for a in now for b in strings}
        if len(longer) > MOST:
            queries.append(_of_strings(now))
            longer, exact = {a[-2:] + b for a in now for b in strings}, False
            if len(longer) > MOST:
                longer = {""}
        now = longer
    if exact:
        return now, True
    return None, _all([*queries, _of_strings(now)])


def query(pattern: str):
    exact, q = _sequence(parser.parse(pattern))
    return _of_strings(exact) if exact is not None else q


def terms(q) -> set[str]:
    if q is True:
        return set()
    return {q[1]} if q[0] == "tri" else set().union(*(terms(x) for x in q[1:]))


def holds(q, present) -> bool:
    """Whether a set of trigrams satisfies a query."""
    if q is True:
        return True
    if q[0] == "tri":
        return q[1] in present
    return (all if q[0] == "and" else any)(holds(x, present) for x in q[1:])
