"""Diagnostics of a policy, before anything is read."""

from __future__ import annotations

from collections import Counter

from framelake.functions.codec import normalize_text
from framelake.plans.policy import ACTIONS, FIELDS, FLAGS, KNOWN, NUMBERS, OPERATORS, ORDERED, Condition, Policy, boolean, number


def condition_problems(c: Condition, where: str) -> list[str]:
    if c.field not in FIELDS:
        return [f"{where}: unknown field {c.field}"]
    if c.operator not in OPERATORS:
        return [f"{where}: unknown operator {c.operator}"]
    if c.operator in KNOWN:
        return [f"{where}: {c.operator} takes no value"] if c.values else []
    out = []
    if c.field in FLAGS and c.operator not in ("is", "is_not"):
        out.append(f"{where}: {c.operator} isn't for yes/no fields")
    if c.field not in NUMBERS and c.operator in (*ORDERED, "between"):
        out.append(f"{where}: {c.operator} is for numbers only")
    wanted = {"between": 2, "in": None, "not_in": None}.get(c.operator, 1)
    if (wanted is None and not c.values) or (wanted is not None and len(c.values) != wanted):
        out.append(f"{where}: {c.operator} takes {wanted or 'at least one'} value(s)")
    if any(not v.strip() for v in c.values):
        out.append(f"{where}: empty value")
    if c.field in NUMBERS and any(number(v) is None for v in c.values):
        out.append(f"{where}: not a number")
    if c.field in FLAGS and any(boolean(v) is None for v in c.values):
        out.append(f"{where}: not true or false")
    return out


def validate(policy: Policy) -> list[str]:
    """All problems, in the order of the document; none if the policy can be used."""
    out = []
    if policy.version != 1:
        out.append(f"unknown version {policy.version}")
    if policy.default_action not in ACTIONS:
        out.append(f"unknown default action {policy.default_action}")
    if policy.default_action == "transcode_with_profile" and policy.profile(policy.default_profile_id) is None:
        out.append("the default profile doesn't exist")
    for what, ids in (("profile", [p.id for p in policy.profiles]), ("rule", [r.id for r in policy.rules])):
        out += [f"{what} id {i} is used {n} times" for i, n in Counter(ids).items() if n > 1]
    names = Counter(p.name.strip().lower() for p in policy.profiles)
    out += [f"profile name {n} is used {k} times" for n, k in names.items() if k > 1]
    for p in policy.profiles:
        if normalize_text(p.codec) not in ("h264", "h265", "av1"):
            out.append(f"profile {p.id}: unknown codec {p.codec}")
        if p.mode == "bitrate" and p.target_kbps <= 0:
            out.append(f"profile {p.id}: no bitrate")
        if p.container == "webm" and normalize_text(p.codec) != "av1":
            out.append(f"profile {p.id}: webm needs av1")
    for r in policy.rules:
        if not r.conditions:
            out.append(f"rule {r.id}: no condition")
        if r.match not in ("all", "any"):
            out.append(f"rule {r.id}: unknown match {r.match}")
        if r.action not in ACTIONS:
            out.append(f"rule {r.id}: unknown action {r.action}")
        if r.action == "transcode_with_profile" and policy.profile(r.profile_id) is None:
            out.append(f"rule {r.id}: profile {r.profile_id} doesn't exist")
        for i, c in enumerate(r.conditions):
            out += condition_problems(c, f"rule {r.id}, condition {i + 1}")
    return out
