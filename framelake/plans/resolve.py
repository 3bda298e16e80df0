"""What is to be done with each file, and with which settings: a policy and three layers of settings, row by row.

Settings are a struct column. The global ones, which a profile may replace in part, lie below those of the file's folder,
and these below those of the node that would do the work; a layer says something where its field isn't null. Folder and
node settings are struct columns too, so one plan resolves every file for every node class that it is joined with.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import codec as C
from framelake.plans.policy import Policy, Profile, Rule, compile_rule, facts
from framelake.plans.validate import validate

#: Settings and what they are where nothing says otherwise.
OUTPUTS = "array<struct<codec:string,layout:string,kbps:int>>"
SETTINGS: dict[str, tuple[str, object]] = {
    "format": ("string", "mkv"),
    "codec": ("string", "h265"),
    "encoder": ("string", "libx265"),
    "hardware": ("string", "auto"),
    "target_kbps": ("int", 3500),
    "strict_bitrate": ("boolean", False),
    "four_k_multiplier": ("int", 4),
    "skip_4k": ("boolean", False),
    "skip_percent": ("int", 20),
    "mode": ("string", "Transcode"),
    "mux_streams": ("string", "Both"),
    "preset": ("string", "medium"),
    "video_profile": ("string", None),
    "video_level": ("string", None),
    "downscale": ("string", "Never"),
    "downscale_target": ("string", "1080p"),
    "frame_size": ("string", None),
    "max_fps": ("int", 0),
    "tonemap": ("boolean", False),
    "crop": ("boolean", False),
    "two_channels": ("boolean", False),
    "audio_codec": ("string", "copy"),
    "audio_kbps": ("int", 0),
    "keep_audio": ("boolean", True),
    "audio_outputs": (OUTPUTS, ()),
    "audio_languages": ("array<string>", ()),
    "subtitle_languages": ("array<string>", ()),
    "keep_original_language": ("boolean", False),
    "sidecars": ("boolean", False),
    "sidecar_format": ("string", "srt"),
    "ocr_subtitles": ("boolean", False),
    "output_directory": ("string", None),
    "encode_directory": ("string", None),
    "delete_original": ("boolean", False),
    "retry": ("boolean", True),
}
MISSING = "the profile doesn't exist"
CONFLICT = "a folder or node names another encoder than the profile"
WRONG_CODEC = "the profile's encoder can't make the codec"


def _literal(value, kind: str) -> Column:
    if isinstance(value, (list, tuple)):
        items = [F.struct(*[F.lit(v).alias(k) for k, v in x.items()]) if isinstance(x, dict) else F.lit(x) for x in value]
        return F.array(*items).cast(kind)
    return F.lit(value).cast(kind)


def settings(**given) -> Column:
    """The global settings as a struct; what isn't given is as in SETTINGS."""
    unknown = given.keys() - SETTINGS.keys()
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return F.struct(*[_literal(given.get(k, default), kind).alias(k) for k, (kind, default) in SETTINGS.items()])


def override(**given: Column) -> Column:
    """A layer: a struct of the settings that are given as columns, null where it says nothing."""
    kinds = {k: kind for k, (kind, _) in SETTINGS.items()}
    return F.struct(*[v.cast(kinds[k]).alias(k) for k, v in given.items()])


def with_profile(base: dict, profile: Profile) -> dict:
    """Global settings with those of a profile in their place."""
    codec = C.normalize_text(profile.codec)
    software = C.SOFTWARE.get(codec, "libx265")
    encoder = profile.encoder or software
    out = base | {"codec": codec, "encoder": encoder, "hardware": C.encoder_device(encoder) if profile.encoder else profile.hardware}
    if profile.mode == "bitrate":
        out |= {"target_kbps": profile.target_kbps, "strict_bitrate": profile.strict_bitrate}
    if profile.preset is not None:
        out["preset"] = profile.preset
    same = ("video_profile", "video_level", "downscale", "downscale_target", "frame_size", "max_fps", "tonemap", "crop")
    return out | {k: getattr(profile, k) for k in same}


def overlaid(options: Column, layer: Column, fields: list[str]) -> Column:
    """Settings under a layer that has the named fields. A codec without an encoder brings its software encoder; audio
    settings of the old kind make outputs anew, unless the layer has outputs of its own."""
    said = lambda k: layer[k] if k in fields else F.lit(None).cast(SETTINGS[k][0])
    new = {k: F.coalesce(said(k), options[k]) for k in SETTINGS}
    new["encoder"] = F.coalesce(said("encoder"), F.when(said("codec").isNotNull(), C.software_encoder(said("codec"))), options["encoder"])
    if {"audio_codec", "audio_kbps", "two_channels"} & {*fields}:
        old = F.coalesce(said("audio_codec").isNotNull() | said("audio_kbps").isNotNull() | said("two_channels").isNotNull(), F.lit(False))
        anew = old & said("audio_outputs").isNull() & said("keep_audio").isNull()
        codec = F.lower(F.trim(F.coalesce(new["audio_codec"], F.lit(""))))
        plain = codec.isin("", "copy")
        one = F.array(F.struct(codec.alias("codec"), F.when(new["two_channels"], "Stereo").otherwise("Source").alias("layout"), F.greatest(new["audio_kbps"], F.lit(0)).alias("kbps"))).cast(OUTPUTS)
        new["audio_outputs"] = F.when(anew & plain, F.array().cast(OUTPUTS)).when(anew, one).otherwise(new["audio_outputs"])
        new["keep_audio"] = F.when(anew, plain).otherwise(new["keep_audio"])
    return F.struct(*[v.alias(k) for k, v in new.items()])


def resolve(files: DataFrame, policy: Policy, base: dict | None = None, folder: str | None = None, node: str | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """`files` with columns plan and options.

    plan is a struct (action, rule_id, rule_name, profile_id, profile_name, encoder, retention, blocked). `folder` and
    `node` name struct columns of settings; the folder's may also have policy (Simple: no policy; Profile: the profile
    profile_id and no other) beside settings. The first enabled rule that fits decides, else the default. A policy with
    problems blocks everything that it would decide. A profile's exact encoder can't be overridden: another one named by
    a folder or node blocks the file, and so does a codec that it can't make. In webm everything is av1. With `nodes`, few
    rows that hold the column `node`, each file gets a row for each of them; what doesn't depend on the node is made once.
    """
    base = base or {}
    f = facts(files)
    layer = lambda name: (nodes if nodes is not None and name == node else files).schema[name].dataType
    fields = lambda name: [x.name for x in layer(name) if x.name in SETTINGS] if name else []
    has = lambda name, k: bool(name) and k in [x.name for x in layer(name)]
    said = lambda name, k: F.col(name)[k] if has(name, k) else F.lit(None).cast("string")
    text = lambda v: F.lit(v).cast("string")
    problems = " ".join(dict.fromkeys(validate(policy))) or None

    kinds: list[tuple] = []  # of decision: a few for each profile and action; their settings come by a join

    def chosen(action: str, rule: Rule | None = None, profile: Profile | None = None, blocked: str | None = None) -> Column:
        """A decision: its kind, and the rule that made it."""
        kind = (action, profile, blocked)
        if kind not in kinds:
            kinds.append(kind)
        return F.struct(F.lit(kinds.index(kind)).alias("kind"), text(rule and rule.id).alias("rule_id"), text(rule and rule.name).alias("rule_name"))

    def of(action: str, rule: Rule | None, profile_id: str | None) -> Column:
        if action != "transcode_with_profile":
            return chosen(action, rule)
        profile = policy.profile(profile_id)
        return chosen(action, rule, profile) if profile else chosen(action, rule, blocked=MISSING)

    simple = chosen("use_simple")
    if not policy.enabled:
        what = simple
    elif problems:
        what = F.when(F.coalesce(said(folder, "policy") == "Simple", F.lit(False)), simple).otherwise(chosen("use_simple", blocked=problems))
    else:
        what = of(policy.default_action, None, policy.default_profile_id)
        for rule in reversed([r for r in policy.rules if r.enabled]):
            what = F.when(compile_rule(rule, f), of(rule.action, rule, rule.profile_id)).otherwise(what)
        forced = chosen("transcode_with_profile", blocked=MISSING)
        for profile in policy.profiles:
            forced = F.when(said(folder, "profile_id") == profile.id, chosen("transcode_with_profile", None, profile)).otherwise(forced)
        what = F.when(F.coalesce(said(folder, "policy") == "Profile", F.lit(False)), forced).when(F.coalesce(said(folder, "policy") == "Simple", F.lit(False)), simple).otherwise(what)

    def row(number: int, action: str, profile: Profile | None, blocked: str | None) -> tuple:
        own = base | (with_profile(base, profile) if profile else {}) | ({"mode": "MuxOnly"} if action == "mux_only" else {"mode": "Transcode"} if profile else {})
        exact = profile.encoder.strip() if profile and profile.encoder else None
        values = [[tuple(x.values()) if isinstance(x, dict) else x for x in v] if isinstance(v, (list, tuple)) else v for v in (own.get(k, default) for k, (_, default) in SETTINGS.items())]
        forced = own["mode"] if action == "mux_only" or profile else None
        return (number, action, profile and profile.id, profile and profile.name, exact, exact and C.encoder_device(exact), profile.retention if profile else "smaller_only", blocked, forced, tuple(values))

    settings(**base)  # unknown ones are an error
    layout = ", ".join(f"{k}: {kind}" for k, (kind, _) in SETTINGS.items())
    choices = files.sparkSession.createDataFrame([row(i, *kind) for i, kind in enumerate(kinds)], f"`the kind` int, action string, profile_id string, profile_name string, encoder string, device string, retention string, blocked string, mode string, options struct<{layout}>")
    choices = choices.select("the kind", F.struct(*choices.columns[1:]).alias("the choice"))
    rows = files.withColumn("the decision", what).withColumn("the kind", F.col("the decision.kind")).join(F.broadcast(choices), "the kind")  # at most two rows for each profile and action
    options = F.col("the choice.options")
    rows = rows.withColumn("options", overlaid(options, F.col(folder), fields(folder)) if folder else options)
    if nodes is not None:
        rows = rows.crossJoin(F.broadcast(nodes))
    if node:
        rows = rows.withColumn("options", overlaid(F.col("options"), F.col(node), fields(node)))
    o, plan = F.col("options"), F.col("the choice")
    profiled = (plan["action"] == "transcode_with_profile") & plan["blocked"].isNull()
    webm = profiled & (F.lower(o["format"]) == "webm")
    exact = plan["encoder"]
    codec = F.when(webm, "av1").otherwise(o["codec"])
    changed = {
        "mode": F.coalesce(plan["mode"], o["mode"]),
        "codec": codec,
        "encoder": F.coalesce(exact, F.when(webm, C.SOFTWARE["av1"]), o["encoder"]),
        "hardware": F.coalesce(plan["device"], o["hardware"]),
    }
    other = [F.lower(said(name, "encoder")) != F.lower(exact) for name in (folder, node) if has(name, "encoder")]
    conflict = F.lit(False)
    for x in other:
        conflict = conflict | F.coalesce(x, F.lit(False))
    wrong = F.coalesce(C.encoder_codec(exact) != C.normalize(codec), F.lit(False))
    blocked = F.when(exact.isNotNull() & wrong, WRONG_CODEC).when(exact.isNotNull() & conflict, CONFLICT).otherwise(plan["blocked"])
    whole = F.struct(*[changed.get(k, o[k]).alias(k) for k in SETTINGS])
    said_by = {"blocked": blocked, "rule_id": F.col("the decision.rule_id"), "rule_name": F.col("the decision.rule_name")}
    decided = F.struct(*[(said_by[k] if k in said_by else plan[k]).alias(k) for k in ("action", "rule_id", "rule_name", "profile_id", "profile_name", "encoder", "retention", "blocked")])
    columns = [*files.columns, *(nodes.columns if nodes is not None else [])]
    return rows.select(*[F.col(c) for c in columns if c not in ("plan", "options")], decided.alias("plan"), whole.alias("options"))


def checked(policy: Policy, **changes) -> Policy:
    """A policy with changes, or an error that tells all its problems."""
    new = replace(policy, **changes)
    problems = validate(new)
    if problems:
        raise ValueError("; ".join(problems))
    return new
