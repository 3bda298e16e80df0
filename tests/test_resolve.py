"""Policy and settings in layers: what the source's own tests ask of them."""

import pytest
from pyspark.sql import functions as F

from framelake.plans import policy as PO
from framelake.plans import resolve as R

FILE = {"codec": "h264", "width": 1920, "height": 1080, "bitrate": 5000, "file_size": 10, "duration": 10, "pixel_format": "yuv420p", "is_hdr": False, "is_4k": False}
EXACT = PO.Profile("x", "Exact", "h265", encoder="hevc_nvenc")
AUTO = PO.Profile("a", "Auto", "av1", "bitrate", 2000, hardware="intel", strict_bitrate=True)


def resolved(spark, policy, folder=None, node=None, base=None):
    df = spark.createDataFrame([tuple(FILE.values())], "codec string, width int, height int, bitrate long, file_size long, duration long, pixel_format string, is_hdr boolean, is_4k boolean")
    kinds = {k: t for k, (t, _) in R.SETTINGS.items()} | {"policy": "string", "profile_id": "string"}
    for name, layer in (("folder", folder), ("node", node)):
        if layer is not None:
            df = df.withColumn(name, F.struct(*[(F.array(*[F.struct(*[F.lit(v).alias(q) for q, v in x.items()]) for x in v]) if isinstance(v, list) else F.lit(v)).cast(kinds[k]).alias(k) for k, v in layer.items()]))
    r = R.resolve(df, policy, base, "folder" if folder is not None else None, "node" if node is not None else None).first()
    return r["plan"], r["options"]


def use(profile, **more):
    return PO.Policy((), (EXACT, AUTO), "transcode_with_profile", profile.id, **more)


def test_layers(spark):
    off = PO.Policy(enabled=False)
    _, o = resolved(spark, off)
    assert (o["format"], o["target_kbps"], o["encoder"], o["audio_outputs"], o["retry"]) == ("mkv", 3500, "libx265", [], True)
    _, o = resolved(spark, off, {"target_kbps": 5000, "hardware": "intel"}, {"hardware": "nvidia", "target_kbps": None})
    assert (o["target_kbps"], o["hardware"]) == (5000, "nvidia")
    for codec, encoder in (("av1", "libsvtav1"), ("AV1", "libsvtav1"), ("h264", "libx264"), ("h265", "libx265")):
        assert resolved(spark, off, {"codec": codec}, base={"encoder": "own"})[1]["encoder"] == encoder
    assert resolved(spark, off, {"codec": "av1", "encoder": "custom"})[1]["encoder"] == "custom"
    one = [{"codec": "ac3", "layout": "5.1", "kbps": 448}]
    assert [x.asDict() for x in resolved(spark, off, {"audio_outputs": one})[1]["audio_outputs"]] == one
    with pytest.raises(ValueError, match="unknown settings"):
        R.settings(colour="red")


def test_old_audio_settings(spark):
    off = PO.Policy(enabled=False)
    _, o = resolved(spark, off, {"audio_codec": " AAC ", "audio_kbps": 192, "two_channels": True})
    assert [tuple(x) for x in o["audio_outputs"]] == [("aac", "Stereo", 192)] and not o["keep_audio"]
    _, o = resolved(spark, off, {"audio_codec": "copy"}, base={"audio_outputs": ({"codec": "opus", "layout": "5.1", "kbps": 0},)})
    assert o["audio_outputs"] == [] and o["keep_audio"]
    _, o = resolved(spark, off, {"audio_codec": "aac", "keep_audio": True})
    assert o["audio_outputs"] == [] and o["keep_audio"] and o["audio_codec"] == "aac"


def test_profiles(spark):
    plan, o = resolved(spark, use(AUTO))
    assert (plan["action"], plan["profile_id"], plan["encoder"], plan["blocked"]) == ("transcode_with_profile", "a", None, None)
    assert (o["codec"], o["encoder"], o["hardware"], o["target_kbps"], o["strict_bitrate"], o["mode"]) == ("av1", "libsvtav1", "intel", 2000, True, "Transcode")
    plan, o = resolved(spark, use(EXACT), {"target_kbps": 1, "mode": "MuxOnly"})
    assert (plan["encoder"], o["encoder"], o["hardware"], o["target_kbps"], o["mode"]) == ("hevc_nvenc", "hevc_nvenc", "nvidia", 1, "Transcode")
    assert resolved(spark, use(EXACT), {"encoder": "libx265"})[0]["blocked"] == R.CONFLICT
    assert resolved(spark, use(EXACT), {"encoder": "HEVC_NVENC"}, {"encoder": "hevc_nvenc"})[0]["blocked"] is None
    assert resolved(spark, use(EXACT), None, {"encoder": "libx265"})[0]["blocked"] == R.CONFLICT
    assert resolved(spark, use(EXACT), {"codec": "av1"})[0]["blocked"] == R.WRONG_CODEC
    assert resolved(spark, use(EXACT), {"format": "WebM"})[0]["blocked"] == R.WRONG_CODEC
    plan, o = resolved(spark, use(PO.Profile("a", "Auto", "av1")), {"format": "webm", "codec": "h264"})
    assert (o["codec"], o["encoder"], plan["blocked"]) == ("av1", "libsvtav1", None)


def test_folders_and_rules(spark):
    rule = PO.Rule("r", "All", (PO.Condition("codec", "is", ("h264",)),), "mux_only")
    policy = PO.Policy((rule,), (EXACT, AUTO), "skip")
    plan, o = resolved(spark, policy, {"policy": "Inherit"})
    assert (plan["action"], plan["rule_id"], o["mode"]) == ("mux_only", "r", "MuxOnly")
    plan, o = resolved(spark, policy, {"policy": "Simple"})
    assert (plan["action"], plan["rule_id"], o["mode"]) == ("use_simple", None, "Transcode")
    plan, o = resolved(spark, policy, {"policy": "Profile", "profile_id": "a"})
    assert (plan["action"], plan["rule_id"], plan["profile_id"], o["codec"]) == ("transcode_with_profile", None, "a", "av1")
    plan, _ = resolved(spark, policy, {"policy": "Profile", "profile_id": "gone"})
    assert (plan["action"], plan["profile_id"], plan["blocked"]) == ("transcode_with_profile", None, R.MISSING)
    plan, _ = resolved(spark, PO.Policy((), (), "skip"))
    assert (plan["action"], plan["retention"]) == ("skip", "smaller_only")
    broken = PO.Policy((PO.Rule("b", "No", (), "skip"),))
    assert "no condition" in resolved(spark, broken)[0]["blocked"] and resolved(spark, broken, {"policy": "Simple"})[0]["blocked"] is None
    with pytest.raises(ValueError, match="no condition"):
        R.checked(broken)


def test_nodes_crossed_after_the_files_own_layers_give_the_same_rows(spark):
    from pyspark.sql import functions as F

    from framelake.plans import resolve as R
    from framelake.policy_queries import _POLICY
    from framelake.sources.adapters import view

    files = view(spark, "/root/testdata/sf0.001", "media_files").where("id < 200").withColumn("folder", R.override(codec=F.when(F.col("id") % 2 == 0, "av1")))
    nodes = spark.range(3).select(F.col("id").alias("class"), R.override(encoder=F.when(F.col("id") == 1, "hevc_nvenc"), target_kbps=F.when(F.col("id") == 2, 900)).alias("node"))
    one = R.resolve(files, _POLICY, folder="folder", node="node", nodes=nodes).select("id", "class", "plan", "options")
    other = R.resolve(files.crossJoin(nodes), _POLICY, folder="folder", node="node").select("id", "class", "plan", "options")
    got = sorted(map(repr, one.collect()))
    assert got == sorted(map(repr, other.collect())) and len(got) == 3 * files.count()
