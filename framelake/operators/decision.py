"""What would happen to a file: skip predicates and dry-run decisions, each one CASE over the file's columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import codec as C
from framelake.functions import media as M
from framelake.functions.paths import extension
from framelake.operators.streams import StreamOptions, audio, has_audio_work, has_subtitle_work, subtitles


@dataclass(frozen=True)
class Options:
    encoder: str = "libx265"
    target_kbps: int = 3500
    four_k_multiplier: int = 4
    skip_percent: int = 20
    skip_4k: bool = False
    strict_bitrate: bool = False
    mode: str = "Transcode"  # Transcode, Hybrid or MuxOnly
    mux_streams: str = "Both"  # Audio, Subtitles or Both
    downscale: str | None = None  # CapAtTarget or Always
    downscale_target: str = "1080p"
    tonemap: bool = False
    crop: bool = False
    vaapi: bool = False
    format: str = "mkv"
    streams: StreamOptions = field(default_factory=StreamOptions)

    @property
    def four_k_kbps(self) -> int:
        return self.target_kbps * min(8, max(2, self.four_k_multiplier))

    @property
    def tolerance(self) -> float:
        return 1.0 + min(100, max(0, self.skip_percent)) / 100.0

    @property
    def codec(self) -> str:
        e = self.encoder.lower()
        return "av1" if "av1" in e or "svt" in e else "hevc" if "265" in e else "h264"

    @property
    def target_height(self) -> int:
        return M.HEIGHTS.get(self.downscale_target, 1080)


@dataclass(frozen=True)
class MusicOptions:
    codec: str = "aac"
    encoder: str = "aac"
    kbps: int = 192
    skip_same: bool = True
    tolerance_percent: int = 10


def would_downscale(o: Options, height: Column) -> Column:
    if o.downscale not in ("CapAtTarget", "Always"):
        return F.lit(False)
    return (height > 0) & (F.lit(o.downscale == "Always") | (height > o.target_height))


def has_active_filter(o: Options) -> Column:
    return F.lit(o.crop) | would_downscale(o, F.col("height")) | (F.lit(o.tonemap) & F.col("is_hdr"))


def needs_container_change(o: Options) -> Column:
    """Whether the file's extension isn't the target's; mp4 and m4v are alike."""
    ext, target = extension(F.col("file_path")), o.format.strip().lower()
    same = (ext == target) | (F.lit(target == "mp4") & (ext == "m4v"))
    return (ext != "") & F.lit(target != "") & ~same


def has_muxable_work(o: Options) -> Column:
    """Stream work that a mux pass would do, among the streams that such passes are for."""
    work = F.lit(False)
    if o.mode != "Transcode" and o.mux_streams in ("Audio", "Both"):
        work = work | has_audio_work(audio(F.col("audio_streams")), o.streams)
    if o.mode != "Transcode" and o.mux_streams in ("Subtitles", "Both"):
        work = work | has_subtitle_work(subtitles(F.col("subtitle_streams")), o.streams)
    return work


def is_no_op(o: Options) -> Column:
    """Whether an encode would copy the video and change no stream."""
    copy = F.col("is_hevc") & (F.col("bitrate") > 0) & (F.col("bitrate") < o.target_kbps + 700)
    return copy & ~has_active_filter(o) & ~has_audio_work(audio(F.col("audio_streams")), o.streams) & ~has_subtitle_work(subtitles(F.col("subtitle_streams")), o.streams)


def would_skip(o: Options, force_mux: bool = False) -> Column:
    """Whether a library file needs nothing. Music never skips here: it has a ladder of its own."""
    at_target = C.meets_target(F.col("codec"), F.col("is_hevc"), o.encoder) & (F.col("bitrate") > 0)
    ceiling = F.when(F.col("is_4k"), F.lit(o.four_k_kbps)).otherwise(F.lit(o.target_kbps))
    return (
        F.when(F.col("kind") == "Music", False)
        .when(F.lit(o.skip_4k) & F.col("is_4k"), True)
        .when(has_muxable_work(o), False)
        .when(F.lit(force_mux) & needs_container_change(o), False)
        .when(F.lit(o.mode == "MuxOnly"), True)
        .when(~at_target, False)
        .when(F.col("bitrate") <= ceiling * F.lit(o.tolerance), True)
        .otherwise(is_no_op(o))
    )


def keep_output(source: Column, output: Column, always: Column, growth: bool, copy: Column) -> Column:
    """Struct (keep, reason) for a finished output."""
    reason = F.when(always, "profile retention policy").when(output < source, "savings").when(F.lit(growth), "configured audio outputs").when(copy, "remux").otherwise("no savings")
    return F.struct((reason != "no savings").alias("keep"), reason.alias("reason"))


def dry_run_video(o: Options, excluded: Column, policy_action: Column | None = None, blocked: Column | None = None, profile_kbps: Column | None = None) -> Column:
    """Struct (decision, target, borderline) of a file under the options, and under a policy's action if there is one:
    Skip, MuxOnly, TranscodeWithProfile or UseSimple."""
    bitrate, hd = F.col("bitrate"), F.col("width") > 1920
    action = policy_action if policy_action is not None else F.lit("UseSimple")
    blocked = F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)
    forced = action == "TranscodeWithProfile"
    at_target = C.meets_target(F.col("codec"), F.col("is_hevc"), o.encoder)
    ceiling_hd, ceiling_4k = int(o.target_kbps * o.tolerance), int(o.four_k_kbps * o.tolerance)
    ceiling = F.when(hd, ceiling_4k).otherwise(ceiling_hd)
    borderline = at_target & (bitrate > ceiling) & (bitrate <= ceiling * 1.3) & (F.col("duration") > 5)
    container = (action == "MuxOnly") & needs_container_change(o)
    mux = has_muxable_work(o) | container
    bypass = F.lit(o.mode != "Transcode") & mux
    below = (bitrate > 0) & (bitrate <= ceiling)
    budget_4k = hd & F.lit(not (o.downscale in ("CapAtTarget", "Always") and o.target_height < 2160))
    reference = F.when(budget_4k, o.four_k_kbps).otherwise(o.target_kbps)
    vaapi = F.lit(o.vaapi and o.codec != "h264") & (~F.col("is_hevc") if o.codec == "hevc" else (F.lower("codec") != "av1")) & (bitrate > 0) & (bitrate <= o.target_kbps) & ~hd
    shrink = (bitrate > 0) & (bitrate < reference + 700) & ~F.col("is_hevc")
    copy = F.col("is_hevc") & (bitrate > 0) & (bitrate < o.target_kbps + 700) & ~has_active_filter(o)
    zero = F.lit(0).cast("long")
    whole = lambda x: x.cast("long")
    rungs = [
        (excluded, "Excluded", zero),
        (F.col("status") == "Completed", "AlreadyCompleted", zero),
        (F.col("status") == "Failed", "AlreadyFailed", zero),
        (F.col("status") == "Cancelled", "AlreadyCancelled", zero),
        (blocked, "Queue", zero),
        (action == "Skip", "Skip", zero),
        (F.lit(o.mode == "MuxOnly") & ~mux, "Skip", zero),
        (~forced & F.lit(o.skip_4k) & hd, "Skip", zero),
        (~forced & at_target & below & ~bypass, "Skip", zero),
        (~forced & vaapi & ~bypass, "Skip", zero),
        (~forced & ~bypass & is_no_op(o), "Skip", zero),
        (forced, "Queue", whole(F.coalesce(profile_kbps, F.lit(0)) if profile_kbps is not None else zero)),
        (F.lit(o.mode != "Transcode") & mux & (F.lit(o.mode == "MuxOnly") | (at_target & below)), "Mux", zero),
        (F.lit(o.strict_bitrate), "Queue", F.lit(o.target_kbps).cast("long")),
        (shrink, "Shrink", whole(bitrate * F.lit(0.7))),
        (copy, "Copy", zero),
    ]
    decision, target = F.lit("Queue"), F.when(bitrate > 0, F.least(whole(reference), bitrate)).otherwise(whole(reference))
    for when, name, kbps in reversed(rungs):
        hit = F.coalesce(when, F.lit(False))
        decision, target = F.when(hit, name).otherwise(decision), F.when(hit, kbps).otherwise(target)
    return F.struct(decision.alias("decision"), target.alias("target"), borderline.alias("borderline"))


def dry_run_music(o: MusicOptions) -> Column:
    """Struct (decision, target) of a music file. The source codec is held against the encoder's name, so only codecs
    whose encoder has the same name can be at target."""
    lossless = o.encoder.lower() in C.LOSSLESS_MUSIC
    same = F.lit(o.skip_same) & (F.lower("codec") == o.encoder.lower())
    t = max(0, o.tolerance_percent)
    band = (F.col("bitrate") > 0) & F.col("bitrate").between(o.kbps * (100 - t) // 100, o.kbps * (100 + t) // 100)
    skip = (F.lower("codec").isin(*C.LOSSY_MUSIC) & F.lit(lossless)) | (same & (F.lit(lossless) | band))
    return F.struct(F.when(skip, "Skip").otherwise("Queue").alias("decision"), F.when(skip, 0).otherwise(o.kbps).cast("long").alias("target"))


def intake_music(o: MusicOptions, changed: Column) -> Column:
    """What a scan does with a music file: codec and bitrate first, then the state of an unchanged file."""
    run = dry_run_music(o)["decision"]
    unchanged = ~F.coalesce(changed, F.lit(False))
    return (
        F.when(run == "Skip", "Skip")
        .when(unchanged & F.col("status").isin("Cancelled", "Completed", "Queued"), "Known")
        .when(unchanged & (F.col("status") == "Failed") & (F.col("failure_count") >= 3), "Failed")
        .otherwise("Queue")
    )


def worker_problem(plan: Column, o: Options, protocol: int = 1) -> Column:
    """Why a worker can't take a plan (struct of protocol, blocked, action, profile_id, resolved_id, encoder,
    profile_encoder), the first reason in this order; null if it can."""
    exact = F.coalesce(plan["encoder"], F.lit(""))
    return (
        F.when(plan["protocol"] != protocol, "protocol not supported")
        .when(F.coalesce(plan["blocked"], F.lit("")) != "", F.concat(F.lit("blocked: "), plan["blocked"]))
        .when(plan["action"] == "skip", "skip must not be dispatched")
        .when((plan["action"] == "mux_only") & F.lit(o.mode != "MuxOnly"), "mux plan needs mux options")
        .when(plan["action"] != "transcode_with_profile", None)
        .when(plan["resolved_id"].isNull(), "profile missing")
        .when(plan["profile_id"].isNotNull() & (plan["profile_id"] != plan["resolved_id"]), "profile mismatch")
        .when(plan["profile_encoder"].isNotNull() & (F.lower(plan["profile_encoder"]) != F.lower(exact)), "encoder mismatch")
        .when(plan["profile_encoder"].isNotNull() & (F.lower(exact) != o.encoder.lower()), "options mismatch")
    )


def filter_analysis(rows: DataFrame, decisions: list[str], needle: str = "") -> DataFrame:
    """Analysis rows (decision, file_path) of a tab: some decisions, and a part of the path."""
    found = rows.where(F.col("decision").isin(*decisions)) if decisions else rows
    return found.where(F.lower("file_path").contains(needle.lower())) if needle else found


def intake(o: Options, excluded: Column, same_file: Column, changed: Column) -> Column:
    """What a scan does with a listed file: exactly unchanged files in a final state end early; failed videos stay
    failed, failed music from the third failure on; changed ones are looked at anew."""
    final = F.col("status").isin("Failed", "Cancelled", "Completed", "Queued")
    stuck = (F.col("status") == "Failed") & ((F.col("kind") != "Music") | (F.col("failure_count") >= 3))
    return (
        F.when(F.coalesce(same_file & final, F.lit(False)), "Unchanged")
        .when(excluded, "Excluded")
        .when(~F.coalesce(changed, F.lit(False)) & F.col("status").isin("Cancelled", "Completed", "Queued"), "Known")
        .when(~F.coalesce(changed, F.lit(False)) & stuck, "Failed")
        .when(would_skip(o), "Skip")
        .otherwise("Queue")
    )


def decision_label(status: Column) -> Column:
    """How the dashboard names a state."""
    return F.when(status == "Pending", "Queued").when(status.isin("Processing", "Uploading", "Downloading"), "Processing").when(status == "NoSavings", "No Savings").otherwise(status)
