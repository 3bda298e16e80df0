"""Rules that can never decide, because an earlier rule fits whatever they fit. Only proven cases are reported.

A condition is read as the set of facts that it admits: intervals, points and exclusions for numbers, names for texts.
"""

from __future__ import annotations

import math

from framelake.functions.codec import normalize_text
from framelake.plans.policy import FLAGS, NUMBERS, Condition, Policy, Rule, boolean, number

Interval = tuple[float, bool, float, bool]  # low, low included, high, high included


def _intervals(c: Condition) -> list[Interval] | None:
    """Numbers that a condition admits; None if it can't be read."""
    values = [number(v) for v in c.values]
    known = [v for v in values if v is not None]
    if not values or values[0] is None:
        return []
    v = values[0]
    point = lambda x: (x, True, x, True)
    gaps = lambda xs: [(a, False, b, False) for a, b in zip([-math.inf, *sorted(set(xs))], [*sorted(set(xs)), math.inf], strict=True)]
    if c.operator == "between":
        return [(min(values[:2]), True, max(values[:2]), True)] if len(values) > 1 and values[1] is not None else []
    return {
        "is": [point(v)],
        "in": [point(x) for x in known],
        "is_not": gaps([v]),
        "not_in": gaps(known),
        "greater_than": [(v, False, math.inf, False)],
        "greater_than_or_equal": [(v, True, math.inf, False)],
        "less_than": [(-math.inf, False, v, False)],
        "less_than_or_equal": [(-math.inf, False, v, True)],
    }.get(c.operator)


def _inside(a: Interval, b: Interval) -> bool:
    low = a[0] > b[0] or (a[0] == b[0] and (b[1] or not a[1]))
    return low and (a[2] < b[2] or (a[2] == b[2] and (b[3] or not a[3])))


def _meet(a: list[Interval], b: list[Interval]) -> list[Interval]:
    out = []
    for x in a:
        for y in b:
            lo, lo_in = max((x[0], not x[1]), (y[0], not y[1]))
            hi, hi_in = min((x[2], x[3]), (y[2], y[3]))
            if lo < hi or (lo == hi and not lo_in and hi_in):
                out.append((lo, not lo_in, hi, hi_in))
    return out


def _names(c: Condition) -> tuple[bool, frozenset[str]]:
    """(admits these, the names), or (admits all but these, the names)."""
    clean = normalize_text if c.field == "codec" else lambda v: v.strip().lower()
    values = c.values[:1] if c.operator in ("is", "is_not") else c.values
    return c.operator in ("is", "in"), frozenset(clean(v) for v in values)


def _flags(c: Condition) -> frozenset[bool]:
    v = boolean(c.values[0]) if c.values else None
    return frozenset() if v is None else frozenset([v if c.operator == "is" else not v])


def implies(given: list[Condition], wanted: Condition) -> bool:
    """Whether facts that fit all of `given` fit `wanted`. Facts that contradict themselves imply nothing here."""
    same = [c for c in given if c.field == wanted.field]
    if not same:
        return False
    unknown = [c for c in same if c.operator == "is_unknown"]
    if wanted.operator == "is_unknown":
        return bool(unknown) and len(unknown) == len(same)
    if unknown:
        return False
    if wanted.operator == "is_known":
        return True
    real = [c for c in same if c.operator != "is_known"]
    if not real:
        return False
    if wanted.field in FLAGS:
        left = frozenset([True, False])
        for c in real:
            left &= _flags(c)
        return bool(left) and left <= _flags(wanted)
    if wanted.field in NUMBERS:
        left: list[Interval] = [(-math.inf, False, math.inf, False)]
        for c in real:
            some = _intervals(c)
            if some is None:
                return False
            left = _meet(left, some)
        right = _intervals(wanted)
        return bool(left) and right is not None and all(any(_inside(x, y) for y in right) for x in left)
    allowed: frozenset[str] | None = None
    banned: frozenset[str] = frozenset()
    for c in real:
        positive, names = _names(c)
        if positive:
            allowed = names if allowed is None else allowed & names
        else:
            banned |= names
    positive, names = _names(wanted)
    if allowed is not None:
        left_names = allowed - banned
        return bool(left_names) and (left_names <= names if positive else not left_names & names)
    return not positive and names <= banned


def subsumed(rule: Rule, by: Rule) -> bool:
    """Whether `by` fits whatever `rule` fits. A rule of alternatives is held against it one alternative at a time."""
    if not rule.conditions or not by.conditions:
        return False
    cases = [list(rule.conditions)] if rule.match == "all" else [[c] for c in rule.conditions]
    fits = all if by.match == "all" else any
    return all(fits(implies(case, c) for c in by.conditions) for case in cases)


def shadowed(policy: Policy) -> list[tuple[str, str]]:
    """(rule, earlier rule) ids of enabled rules that can never decide."""
    live = [r for r in policy.rules if r.enabled]
    out = []
    for i, rule in enumerate(live):
        by = next((e for e in live[:i] if subsumed(rule, e)), None)
        if by:
            out.append((rule.id, by.id))
    return out
