"""The rule language: a policy of ordered rules over source facts, compiled to one CASE expression."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import codec as C
from framelake.functions import media as M

NUMBERS = ("width", "height", "bitrate_kbps", "file_size_bytes", "duration_seconds", "bit_depth")
TEXTS = ("codec", "resolution_class", "pixel_format")
FLAGS = ("is_hdr", "is_4k")
FIELDS = (*TEXTS, *NUMBERS, *FLAGS)
KNOWN = ("is_known", "is_unknown")
ORDERED = ("greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal")
OPERATORS = ("is", "is_not", "in", "not_in", *ORDERED, "between", *KNOWN)
ACTIONS = ("use_simple", "skip", "mux_only", "transcode_with_profile")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    conditions: tuple[Condition, ...]
    action: str
    profile_id: str | None = None
    match: str = "all"  # all or any
    enabled: bool = True


@dataclass(frozen=True)
class Profile:
    id: str
    name: str
    codec: str = "h265"
    mode: str = "quality"  # quality or bitrate
    target_kbps: int = 0
    encoder: str | None = None  # named exactly; else the software encoder of the codec
    container: str | None = None
    hardware: str = "auto"
    strict_bitrate: bool = False
    preset: str | None = "medium"
    video_profile: str | None = None
    video_level: str | None = None
    downscale: str = "Never"
    downscale_target: str = "1080p"
    frame_size: str | None = None
    max_fps: int = 0
    tonemap: bool = False
    crop: bool = False
    retention: str = "smaller_only"


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...] = ()
    profiles: tuple[Profile, ...] = ()
    default_action: str = "use_simple"
    default_profile_id: str | None = None
    enabled: bool = True
    version: int = 1

    def profile(self, id_: str | None) -> Profile | None:
        return next((p for p in self.profiles if p.id == id_), None)


def from_json(text: str) -> Policy:
    """A policy from its document: keys as in the dataclasses."""
    d = json.loads(text)
    rules = tuple(Rule(**{**r, "conditions": tuple(Condition(c["field"], c["operator"], tuple(c.get("values", ()))) for c in r.get("conditions", ()))}) for r in d.get("rules", ()))
    profiles = tuple(Profile(**p) for p in d.get("profiles", ()))
    return Policy(rules, profiles, **{k: d[k] for k in ("default_action", "default_profile_id", "enabled", "version") if k in d})


def number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def boolean(text: str) -> bool | None:
    return {"true": True, "false": False}.get(text.strip().lower())


def facts(files: DataFrame) -> dict[str, Column]:
    """Facts of library files; null where unknown."""
    c = F.col
    return {
        "codec": F.when(F.trim(F.coalesce(c("codec"), F.lit(""))) != "", C.normalize(c("codec"))),
        "width": M.known(c("width")),
        "height": M.known(c("height")),
        "resolution_class": M.resolution_class(c("width"), c("height")),
        "bitrate_kbps": M.known(c("bitrate")),
        "file_size_bytes": M.known(c("file_size")),
        "duration_seconds": M.known(c("duration")),
        "pixel_format": F.nullif(F.lower(F.trim(c("pixel_format"))), F.lit("")),
        "bit_depth": M.bit_depth(c("pixel_format")),
        "is_hdr": c("is_hdr"),
        "is_4k": c("is_4k"),
    }


def compile_condition(condition: Condition, f: dict[str, Column]) -> Column:
    """True or false, never null: an unknown fact fits `is_unknown` alone."""
    actual, op, values = f[condition.field], condition.operator, condition.values
    never = F.lit(False)
    if op == "is_known":
        return actual.isNotNull()
    if op == "is_unknown":
        return actual.isNull()
    if condition.field in FLAGS:
        expected = boolean(values[0]) if values else None
        out = never if expected is None or op not in ("is", "is_not") else actual == expected if op == "is" else actual != expected
    elif condition.field in NUMBERS:
        parsed = [number(v) for v in values]
        if not parsed or parsed[0] is None:
            return never
        x, first, known = actual.cast("double"), parsed[0], [v for v in parsed if v is not None]
        if op == "between":
            out = never if len(parsed) < 2 or parsed[1] is None else x.between(min(parsed[:2]), max(parsed[:2]))
        else:
            out = {"is": x == first, "is_not": x != first, "in": x.isin(*known), "not_in": ~x.isin(*known), "greater_than": x > first, "greater_than_or_equal": x >= first, "less_than": x < first, "less_than_or_equal": x <= first}[op]
    else:
        clean = C.normalize_text if condition.field == "codec" else lambda v: v.strip().lower()
        named = [clean(v) for v in values]
        x = F.lower(F.trim(actual))
        out = {"is": x == named[0] if named else never, "is_not": x != named[0] if named else never, "in": x.isin(*named) if named else never, "not_in": ~x.isin(*named) if named else F.lit(True)}.get(op, never)
        out = out & actual.isNotNull()
    return F.coalesce(out, never)


def compile_rule(rule: Rule, f: dict[str, Column]) -> Column:
    """A rule without conditions fits nothing."""
    if not rule.conditions:
        return F.lit(False)
    out = compile_condition(rule.conditions[0], f)
    for c in rule.conditions[1:]:
        nxt = compile_condition(c, f)
        out = (out & nxt) if rule.match == "all" else (out | nxt)
    return out


def blocked_reason(policy: Policy, rule: Rule | None) -> str | None:
    """Why a decision can't be carried out."""
    action = rule.action if rule else policy.default_action
    if action != "transcode_with_profile":
        return None
    profile = policy.profile(rule.profile_id if rule else policy.default_profile_id)
    if profile is None:
        return "profile missing"
    if profile.mode == "bitrate" and profile.target_kbps <= 0:
        return "bitrate missing"
    if profile.encoder and profile.container == "webm" and C.normalize_text(profile.codec) != "av1":
        return "webm needs av1"
    return None


def assign(files: DataFrame, policy: Policy, folder_policy: str | None = None) -> DataFrame:
    """`files` with a column plan: struct (action, rule_id, rule_name, profile_id, profile_name, target_kbps, blocked).

    The first enabled rule that fits decides, else the default; a folder whose `folder_policy` column is Off uses the
    simple settings. Disabled policies use them for every file."""
    f = facts(files)

    def plan(rule: Rule | None, simple: bool = False) -> Column:
        action = "use_simple" if simple else rule.action if rule else policy.default_action
        profile = policy.profile(rule.profile_id if rule else policy.default_profile_id) if action == "transcode_with_profile" else None
        reason = None if simple else blocked_reason(policy, rule)
        text = lambda v: F.lit(v).cast("string")
        return F.struct(
            text(action).alias("action"),
            text(rule.id if rule else None).alias("rule_id"),
            text(rule.name if rule else None).alias("rule_name"),
            text(profile.id if profile else None).alias("profile_id"),
            text(profile.name if profile else None).alias("profile_name"),
            F.lit(profile.target_kbps if profile and profile.mode == "bitrate" else None).cast("long").alias("target_kbps"),
            text(reason).alias("blocked"),
        )

    if not policy.enabled:
        return files.withColumn("plan", plan(None, simple=True))
    out = plan(None)
    for rule in reversed([r for r in policy.rules if r.enabled]):
        out = F.when(compile_rule(rule, f), plan(rule)).otherwise(out)
    if folder_policy:
        out = F.when(F.coalesce(F.col(folder_policy) == "Off", F.lit(False)), plan(None, simple=True)).otherwise(out)
    return files.withColumn("plan", out)


def bucket_key() -> Column:
    p = F.col("plan")
    return F.when(p["blocked"].isNotNull(), F.concat(F.lit("blocked:"), p["blocked"])).when(p["action"] == "transcode_with_profile", F.concat(F.lit("profile:"), p["profile_id"])).otherwise(F.concat(F.lit("action:"), p["action"]))


def impact(planned: DataFrame) -> DataFrame:
    """What a policy would do to the library, by outcome: files, bytes, projected bytes, what is done already, rules."""
    p = F.col("plan")
    projected = F.when(p["blocked"].isNull() & (p["target_kbps"] > 0) & (F.col("duration") > 0), (p["target_kbps"] * F.lit(125.0) * F.col("duration")).cast("long"))
    rows = planned.groupBy(bucket_key().alias("bucket")).agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(F.when(F.col("file_size") > 0, F.col("file_size"))), F.lit(0)).alias("bytes"),
        F.sum(projected).alias("projected_bytes"),
        F.count_if(F.col("status").isin("Completed", "Skipped")).alias("already_processed"),
        F.array_join(F.array_sort(F.collect_set(p["rule_name"])), ",").alias("rules"),
        F.first(F.coalesce(p["profile_name"], p["blocked"], p["action"])).alias("label"),
    )
    return rows.orderBy(F.desc("files"), F.desc("bytes"), F.lower("label"), "bucket")


def rule_counts(planned: DataFrame) -> DataFrame:
    """Files of each rule; those that no rule fits and nothing blocks count as unmatched."""
    name = F.coalesce(F.col("plan.rule_id"), F.when(F.col("plan.blocked").isNull(), F.lit("unmatched")))
    return planned.select(name.alias("rule")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("files"))


def samples(planned: DataFrame, n: int = 8) -> DataFrame:
    """The first n files of each outcome by id."""
    from pyspark.sql import Window

    ranked = planned.select(bucket_key().alias("bucket"), "id", "file_name").withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("id")))
    return ranked.where(F.col("rank") <= n)  # Spark keeps n rows a bucket before it shuffles


def find_files(planned: DataFrame, needle: str, limit: int = 5) -> DataFrame:
    return planned.where(F.lower("file_name").contains(needle.lower())).orderBy("id").limit(limit).select("id", "file_name", F.col("plan.action").alias("action"))


def layered(global_: dict, *overrides: dict | None) -> dict:
    """Settings: later layers win where they say anything. A codec without an encoder brings back the codec's own."""
    out = dict(global_)
    for layer in overrides:
        for k, v in (layer or {}).items():
            if v is not None:
                out[k] = v
        if layer and layer.get("codec") and not layer.get("encoder"):
            out["encoder"] = {"h265": "libx265", "h264": "libx264", "av1": "libsvtav1"}.get(C.normalize_text(layer["codec"]), out.get("encoder"))
    return out


def rebuild(policy: Policy, **changes) -> Policy:
    return replace(policy, **changes)
