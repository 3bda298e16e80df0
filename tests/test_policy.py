"""The rule language: matching, plans, validation, shadowing."""

import pytest
from pyspark.sql import functions as F

from framelake.plans import policy as PO
from framelake.plans.shadow import implies, shadowed
from framelake.plans.validate import validate

SCHEMA = "id long, file_name string, codec string, width int, height int, bitrate long, file_size long, duration long, pixel_format string, is_hdr boolean, is_4k boolean, status string"
ROWS = [
    (1, "a.mkv", "h264", 3840, 2160, 20000, 1000, 5400, "yuv420p", False, True, "Completed"),
    (2, "b.mkv", "hevc", 3840, 2160, 15000, 2000, 5400, "yuv420p10le", True, True, "Queued"),
    (3, "c.mkv", "h264", 1920, 1080, 8000, 3000, 5400, "yuv420p", False, False, "Skipped"),
    (4, "d.mkv", "", 0, 0, 0, 0, 0, None, None, None, "Queued"),
]
C = PO.Condition


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def hits(files, *conditions, match="all"):
    rule = PO.Rule("r", "r", tuple(conditions), "skip", match=match)
    return [r["id"] for r in files.where(PO.compile_rule(rule, PO.facts(files))).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("conditions", "expected"),
    [
        ((C("codec", "is", ("x265",)),), [2]),
        ((C("codec", "is_not", ("h264",)),), [2]),
        ((C("codec", "is_unknown"),), [4]),
        ((C("width", "is_known"),), [1, 2, 3]),
        ((C("bitrate_kbps", "between", ("16000", "8000")),), [2, 3]),
        ((C("bitrate_kbps", "in", ("x", "8000")),), []),
        ((C("bitrate_kbps", "in", ("8000", "x")),), [3]),
        ((C("bitrate_kbps", "not_in", ("8000",)),), [1, 2]),
        ((C("resolution_class", "in", ("2160P+ ",)),), [1, 2]),
        ((C("bit_depth", "greater_than", ("8",)),), [2]),
        ((C("is_hdr", "is", ("True",)),), [2]),
        ((C("is_hdr", "is_not", ("true",)),), [1, 3]),
        ((C("is_hdr", "greater_than", ("true",)),), []),
        ((C("codec", "not_in", ()),), [1, 2, 3]),
        ((C("file_size_bytes", "less_than", ("nan x",)),), []),
        ((), []),
    ],
)
def test_conditions(files, conditions, expected):
    assert hits(files, *conditions) == expected


def test_any_and_all(files):
    pair = (C("codec", "is", ("hevc",)), C("width", "less_than", ("2000",)))
    assert hits(files, *pair) == []
    assert hits(files, *pair, match="any") == [2, 3]


POLICY = PO.Policy(
    rules=(PO.Rule("r1", "4K", (C("is_4k", "is", ("true",)),), "transcode_with_profile", "p"), PO.Rule("r2", "H264", (C("codec", "is", ("avc",)),), "skip")),
    profiles=(PO.Profile("p", "Small", "av1", "bitrate", 3500),),
)


def test_first_rule_wins_and_impact(files):
    planned = PO.assign(files, POLICY)
    assert [r["r"] for r in planned.orderBy("id").select(F.col("plan.rule_id").alias("r")).collect()] == ["r1", "r1", "r2", None]
    rows = {r["bucket"]: r for r in PO.impact(planned).collect()}
    assert rows["profile:p"]["projected_bytes"] == 2 * 3500 * 125 * 5400
    assert rows["profile:p"]["already_processed"] == 1 and rows["action:skip"]["already_processed"] == 1
    assert {r["rule"]: r["files"] for r in PO.rule_counts(planned).collect()} == {"r1": 2, "r2": 1, "unmatched": 1}


def test_disabled_policy_and_missing_profile(files):
    off = PO.assign(files, PO.rebuild(POLICY, enabled=False))
    assert {r["a"] for r in off.select(F.col("plan.action").alias("a")).collect()} == {"use_simple"}
    gone = PO.assign(files, PO.rebuild(POLICY, profiles=()))
    assert "blocked:profile missing" in {r["bucket"] for r in PO.impact(gone).collect()}


def test_document_round_trip():
    text = '{"rules": [{"id": "a", "name": "A", "action": "skip", "conditions": [{"field": "codec", "operator": "is", "values": ["av1"]}]}], "default_action": "mux_only"}'
    read = PO.from_json(text)
    assert read.rules[0].conditions == (C("codec", "is", ("av1",)),) and read.default_action == "mux_only"
    assert validate(read) == []


def test_layers():
    base = {"codec": "h265", "encoder": "hevc_nvenc", "kbps": 3500}
    assert PO.layered(base, {"kbps": 900}, {"kbps": None, "codec": "av1"}) == {"codec": "av1", "encoder": "libsvtav1", "kbps": 900}


@pytest.mark.parametrize(
    ("rule", "problem"),
    [
        (PO.Rule("r", "r", (C("codec", "between", ("a", "b")),), "skip"), "numbers only"),
        (PO.Rule("r", "r", (C("width", "is", ("wide",)),), "skip"), "not a number"),
        (PO.Rule("r", "r", (C("width", "between", ("1",)),), "skip"), "takes 2"),
        (PO.Rule("r", "r", (C("is_4k", "is", ("maybe",)),), "skip"), "true or false"),
        (PO.Rule("r", "r", (), "skip"), "no condition"),
        (PO.Rule("r", "r", (C("codec", "is", ("a",)),), "transcode_with_profile", "x"), "doesn't exist"),
    ],
)
def test_validation(rule, problem):
    assert any(problem in p for p in validate(PO.Policy(rules=(rule,))))


@pytest.mark.parametrize(
    ("earlier", "later", "hidden"),
    [
        ([C("width", "greater_than", ("1000",))], [C("width", "between", ("1500", "2000"))], True),
        ([C("width", "greater_than", ("1000",))], [C("width", "greater_than_or_equal", ("1000",))], False),
        ([C("codec", "in", ("hevc", "av1"))], [C("codec", "is", ("x265",))], True),
        ([C("codec", "is_not", ("h264",))], [C("codec", "in", ("av1", "vp9"))], True),
        ([C("codec", "is_not", ("h264",))], [C("codec", "in", ("av1", "avc"))], False),
        ([C("codec", "is_known")], [C("codec", "is", ("av1",))], True),
        ([C("codec", "is_unknown")], [C("codec", "is_unknown"), C("width", "is_known")], True),
        ([C("is_4k", "is_not", ("false",))], [C("is_4k", "is", ("true",))], True),
        ([C("width", "is_not", ("5",))], [C("width", "less_than", ("5",))], True),
        ([C("width", "is", ("5",))], [C("width", "less_than", ("1",)), C("width", "greater_than", ("2",))], False),
        ([C("codec", "is", ("av1",)), C("is_4k", "is", ("true",))], [C("codec", "is", ("av1",))], False),
    ],
)
def test_shadowing(earlier, later, hidden):
    rules = (PO.Rule("a", "a", tuple(earlier), "skip"), PO.Rule("b", "b", tuple(later), "skip"))
    assert shadowed(PO.Policy(rules=rules)) == ([("b", "a")] if hidden else [])


def test_alternatives_and_disabled_rules():
    a = PO.Rule("a", "a", (C("codec", "is", ("av1",)), C("width", "greater_than", ("100",))), "skip", match="any")
    b = PO.Rule("b", "b", (C("codec", "is", ("av1",)), C("width", "greater_than", ("200",))), "skip", match="any")
    assert shadowed(PO.Policy(rules=(a, b))) == [("b", "a")]
    assert shadowed(PO.Policy(rules=(PO.Rule("a", "a", a.conditions, "skip", match="any", enabled=False), b))) == []


def test_implication_is_sound(files):
    """Where one condition is said to imply another, no row fits the first alone."""
    some = [C("width", o, v) for o in ("is", "is_not", "greater_than", "less_than_or_equal", "in", "not_in") for v in (("1920",), ("3840",))] + [C("codec", o, (v,)) for o in ("is", "is_not", "in") for v in ("h264", "hevc")] + [C("width", "is_known"), C("codec", "is_unknown")]
    for x in some:
        for y in some:
            if implies([x], y):
                assert set(hits(files, x)) <= set(hits(files, y)), (x, y)
