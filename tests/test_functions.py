"""Scalar functions, streams, decisions, placement, sources on small rows."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framelake.functions import language as L
from framelake.functions import media as M
from framelake.functions import ocr
from framelake.functions import paths as P
from framelake.functions import schedule as S
from framelake.functions import titles as T
from framelake.operators import decision as D
from framelake.operators import ledger, placement, queue, scan
from framelake.operators import streams as A
from framelake.sources import files as FS
from framelake.streaming import feeds


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "depth"), [("yuv420p", 8), ("yuv420p10le", 10), ("p010le", 10), ("gray12be", 12), ("x2rgb10le", 10), ("V210", 10), ("y210le", 10), ("nv12", 8), ("", None), (None, None)])
def test_bit_depth(spark, name, depth):
    assert one(spark, M.bit_depth(F.lit(name).cast("string"))) == depth


@pytest.mark.parametrize(
    ("path", "kind", "title"),
    [
        ("/tv/Some.Show.S01E02.1080p.mkv", "Tv", "Some Show"),
        ("/tv/[Group] Other Show - 07 [720p].mkv", "Tv", "Other Show"),
        ("/tv/Third_Show.2x05.mkv", "Tv", "Third Show"),
        ("/tv/Season 1/Pilot.mkv", "Tv", "Pilot"),
        ("/movies/Plain Movie.mkv", "Movie", "Plain Movie"),
    ],
)
def test_series(spark, path, kind, title):
    assert one(spark, T.classify(F.lit(path))) == kind
    assert one(spark, T.series_title(F.lit(path))) == title


@pytest.mark.parametrize(("path", "expected"), [("/m/Alpha (2010).mkv", ("Alpha", 2010)), ("/m/2001 A Space Odyssey (1968).mkv", ("2001 A Space Odyssey", 1968)), ("/m/2012.mkv", ("2012", None)), ("/m/Beta.1999.2005.x264.mkv", ("Beta 1999", 2005)), ("/m/Gamma [x].mkv", ("Gamma", None))])
def test_movies(spark, path, expected):
    assert tuple(one(spark, T.movie_title(F.lit(path)))) == expected


@pytest.mark.parametrize(("raw", "two"), [("ENG", "en"), (" fre ", "fr"), ("German", "de"), ("xx", None), ("", None), (None, None)])
def test_language(spark, raw, two):
    assert one(spark, L.two_letter(F.lit(raw).cast("string"))) == two


def test_language_of_titles(spark):
    assert one(spark, L.from_title(F.lit("Full [English] SDH"))) == "en"
    assert one(spark, L.is_sdh(F.lit("Chichewa"))) is False and one(spark, L.is_sdh(F.lit("for-the hearing impaired"))) is True
    assert one(spark, L.matches(F.lit("tlh"), F.lit(None).cast("string"), ["TLH"])) is True
    reorder = lambda langs: one(spark, L.would_reorder(F.array(*[F.lit(x) for x in langs]), ["en", "jpn"]))
    assert reorder(["jpn", "eng"]) and not reorder(["eng", "ja", "eng"]) and not reorder(["eng"])


WEEK = '[{"days":["Friday"],"start":"22:00","end":"06:00"},{"days":["Monday"],"start":"09:00","end":"17:00"},{"days":["Sunday"],"start":"8:00","end":"8:00"}]'


@pytest.mark.parametrize(("moment", "open_"), [("2024-01-05 23:00", True), ("2024-01-06 05:59", True), ("2024-01-06 06:00", False), ("2024-01-05 05:00", False), ("2024-01-08 09:00", True), ("2024-01-08 17:00", False), ("2024-01-07 03:00", True)])
def test_schedule(spark, moment, open_):
    windows = F.from_json(F.lit(WEEK), "array<struct<days:array<string>,start:string,end:string>>")
    assert one(spark, S.within(windows, F.lit(moment).cast("timestamp"))) is open_


def test_odd_schedules(spark):
    kind = "array<struct<days:array<string>,start:string,end:string>>"
    now = F.lit("2024-01-08 10:00").cast("timestamp")
    assert one(spark, S.within(F.lit(None).cast(kind), now)) is True
    assert one(spark, S.within(F.from_json(F.lit("[]"), kind), now)) is True
    assert one(spark, S.within(F.from_json(F.lit('[{"days":[],"start":"00:00","end":"00:00"}]'), kind), now)) is False
    assert one(spark, S.within(F.from_json(F.lit('[{"days":["Monday"],"start":"24:00","end":"x"}]'), kind), now)) is False


def test_durations_and_rates(spark):
    assert one(spark, S.seconds(F.lit("1:02:03.5"))) == 3723.5 and one(spark, S.seconds(F.lit("n/a"))) == 0.0
    assert one(spark, S.clock(F.lit(3723.9))) == "01:02:03"
    assert one(spark, M.frame_rate(F.lit("0/0"))) is None and one(spark, M.gop(F.lit(12.25))) == 24 and one(spark, M.gop(F.lit(None).cast("double"))) == 48
    assert one(spark, M.kbps_from_size(F.lit(1000), F.lit(0))) == 0


def test_calibration_narrows():
    assert M.calibration_step([(20, 5000), (30, 2000)], 3000, 10, 40) == 25
    assert 30 < M.calibration_step([(20, 8000), (25, 6000)], 3000, 10, 40) <= 40


def test_prefixes(spark):
    files = spark.createDataFrame([(1, "/a/b/c/x.mkv"), (2, "/A/B/y.mkv"), (3, "/ab/z.mkv"), (4, None)], "id int, file_path string")
    folders = spark.createDataFrame([("/a/", "one"), ("/a/b/c", "two"), ("/A/b", "three")], "root string, name string")
    assert {r["id"]: r["name"] for r in P.longest_prefix(files, folders).collect()} == {1: "two", 2: "three", 3: None, 4: None}


def test_like_and_glob(spark):
    assert one(spark, P.like_escaped(F.lit("x NATION_7 y"), "nation_7")) is True and one(spark, P.like_escaped(F.lit("nationX7"), "nation_7")) is False
    assert one(spark, P.glob(F.lit("Show.S01.mkv"), "*.s??.MKV")) is True and one(spark, P.glob(F.lit("a+b"), "a+b?")) is False


def test_aligned_tail(spark):
    assert one(spark, P.aligned_tail(F.lit("/mnt/media/tv/Show/x.mkv"), "/data/media/TV")) == "Show/x.mkv"
    assert one(spark, P.aligned_tail(F.lit("/mnt/other/x.mkv"), "/data/media")) is None


AUDIO = '[{"l":"eng","c":"ac3","ch":6,"t":"Main"},{"l":"eng","c":"aac","ch":2,"t":"Commentary"},{"l":"jpn","c":"opus","ch":2,"t":null}]'


def audio_work(spark, text, **options):
    return one(spark, A.has_audio_work(A.audio(F.lit(text)), A.StreamOptions(**options)))


def test_audio_work(spark):
    assert audio_work(spark, AUDIO) is True  # a commentary
    plain = '[{"l":"eng","c":"aac","ch":2,"t":null}]'
    assert audio_work(spark, plain) is False and audio_work(spark, "broken") is False and audio_work(spark, "[]") is False
    assert audio_work(spark, plain, audio_languages=("fr",)) is True and audio_work(spark, plain, audio_languages=("en",)) is False
    assert audio_work(spark, plain, audio_outputs=(A.AudioOutput("AAC", "stereo"),)) is False
    assert audio_work(spark, plain, audio_outputs=(A.AudioOutput("aac", "5.1"),)) is True
    assert audio_work(spark, plain, preserve_original_audio=False, audio_outputs=(A.AudioOutput("aac"),)) is True


def test_subtitle_work(spark):
    work = lambda text, **o: one(spark, A.has_subtitle_work(A.subtitles(F.lit(text)), A.StreamOptions(**o)))
    image = '[{"l":"eng","c":"hdmv_pgs_subtitle","t":null,"s":true}]'
    assert work(image) is False and work(image, exclude_sdh=True) is True and work(image, convert_images=True) is True
    assert work(image, pass_images_mkv=False) is True and work(image, pass_images_mkv=False, format="mp4") is False
    assert work(image, extract_sidecar=True) is True and work("[]", extract_sidecar=True) is False


def test_audio_plan(spark):
    """Copies before encodes in each bucket, no track twice, nothing mixed up, no bucket and no file left without audio."""
    tracks = '[{"l":"eng","c":"truehd","ch":8,"t":"Main"},{"l":"eng","c":"aac","ch":2,"t":null},{"l":"fre","c":"dts","ch":6,"t":"VF"},{"l":"eng","c":"ac3","ch":2,"t":"Commentary"}]'
    out = (A.AudioOutput("aac", "stereo"), A.AudioOutput("opus", "5.1", 256))

    def plan(text=tracks, **o):
        steps = one(spark, A.audio_plan(A.audio(F.lit(text)), A.StreamOptions(**o)))
        assert [s["output"] for s in steps] == list(range(len(steps)))
        return [(s["bucket"], s["action"], s["source"], s["codec"], s["channels"], s["kbps"]) for s in steps]

    assert plan(audio_languages=("fr", "en"), audio_outputs=out) == [
        ("fr", "copy", 2, "dts", 6, 0), ("fr", "encode", 2, "aac", 2, 192), ("fr", "encode", 2, "opus", 6, 256),
        ("en", "copy", 0, "truehd", 8, 0), ("en", "copy", 1, "aac", 2, 0), ("en", "encode", 0, "opus", 6, 256),
    ]
    assert plan(audio_languages=("en",), audio_outputs=out, preserve_original_audio=False) == [("en", "copy", 1, "aac", 2, 0), ("en", "encode", 0, "opus", 6, 256)]
    assert plan(audio_languages=("fr",), audio_outputs=(A.AudioOutput("aac", "7.1"),), preserve_original_audio=False) == [("fr", "copy", 2, "dts", 6, 0)]
    assert [s[:3] for s in plan(audio_languages=("ja",), preserve_original_audio=False)] == [("und", "copy", i) for i in (0, 1, 2)]
    assert plan(audio_languages=("fr",), format="mp4") == [("fr", "encode", 2, "aac", 6, 0)]
    assert plan(audio_languages=("fr",), format="webm", audio_outputs=(A.AudioOutput("ac3", "5.1", 448),)) == [("fr", "encode", 2, "opus", 6, 0), ("fr", "encode", 2, "opus", 6, 448)]
    assert plan('[{"l":"eng","c":"aac","ch":2,"t":"Commentary"}]') == [("und", "copy", 0, "aac", 2, 0)]
    assert plan("[]") == [] and plan("broken", audio_languages=("en",)) == []
    assert A.with_original(("en",), "ja") == ("en", "ja") and A.with_original((), "ja") == ()


def test_folders_few_and_many(spark, monkeypatch):
    rows = [(i, p) for i, p in enumerate(["/m/A/b/x.mkv", "/m/a/y.mkv", "/m/z.mkv", "/n/a/b/c/d.mkv", "/m/ab/q.mkv", None])]
    df = spark.createDataFrame(rows, "id long, file_path string")
    folders = spark.createDataFrame([("/m/a/", 1), ("/M/a/B", 2), ("/n/a", 3), ("/n/a", 3), ("/m/a/y.mkv", 9)], "root string, rank int")
    seen = []
    for few in (100, 0):
        monkeypatch.setattr(P, "FEW_FOLDERS", few)
        seen.append(sorted(map(tuple, P.longest_prefix(df, folders).collect()), key=str))
        assert P.longest_prefix(df, folders.where("false")).where("rank is not null").count() == 0
    assert seen[0] == seen[1] and {r[0]: r[3] for r in seen[0]} == {0: 2, 1: 1, 2: None, 3: 3, 4: None, 5: None}


def test_slots_and_candidates(spark):
    slots = spark.createDataFrame([("j1", "n", "nvidia", "Encoding", 5)], "job_id string, node_id string, device_id string, phase string, progress int")
    places = spark.createDataFrame([("n", "nvidia", 2), ("n", "cpu", 0)], "node_id string, device_id string, cap int")
    wishes = spark.createDataFrame([("a", "n", "nvidia", 2), ("b", "n", "nvidia", 1), ("j1", "n", "nvidia", 0), ("c", "n", "cpu", 0), ("", "n", "nvidia", 0), ("d", "m", "cpu", 0)], "job_id string, node_id string, device_id string, asked int")
    now = placement.reserve(slots, wishes, places)
    assert {(r["job_id"], r["phase"]) for r in now.collect()} == {("j1", "Encoding"), ("b", "Reserved")}
    moves = spark.createDataFrame([("b", "b2"), ("j1", "b"), ("gone", "x")], "job_id string, new_id string")
    assert {r["job_id"] for r in placement.rekey(now, moves).collect()} == {"b2", "j1"}
    assert [r["job_id"] for r in placement.release(now, moves.where("job_id = 'b'")).collect()] == ["j1"]
    items = spark.createDataFrame([(1, "Music", "Pending", 0), (2, "Video", "Pending", 2), (3, "Video", "Pending", 1), (4, "Video", "Done", 0)], "id long, kind string, status string, place int")
    first = lambda ids, skip: [r["id"] for r in placement.first_local(items, items.where(F.col("id").isin(*ids)), F.col("id") == skip).collect()]
    assert first([], 0) == [3] and first([3], 0) == [2] and first([3], 2) == []


def files(spark, *rows):
    schema = "id long, file_path string, kind string, codec string, is_hevc boolean, is_4k boolean, is_hdr boolean, bitrate long, width int, height int, duration long, status string, audio_streams string, subtitle_streams string, failure_count int"
    return spark.createDataFrame(rows, schema)


def video(id_, codec, bitrate, width=1920, status="Queued", audio="[]", name="x.mkv", kind="Video", failures=0):
    return (id_, f"/m/{name}", kind, codec, codec == "hevc", width > 1920, False, bitrate, width, 1080, 100, status, audio, "[]", failures)


def test_skip_ladder(spark):
    df = files(spark, video(1, "hevc", 3000), video(2, "hevc", 9000), video(3, "h264", 1000), video(4, "av1", 4200), video(5, "hevc", 12000, 3840), video(6, "hevc", 4201), video(7, "hevc", 0), video(8, "hevc", 100, kind="Music"))
    got = {r["id"]: r["s"] for r in df.select("id", D.would_skip(D.Options()).alias("s")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False, 8: False}
    assert [r["s"] for r in df.where("id = 5").select(D.would_skip(D.Options(mode="MuxOnly")).alias("s")).collect()] == [True]
    assert [r["s"] for r in df.where("id = 1").select(D.would_skip(D.Options(format="mp4"), force_mux=True).alias("s")).collect()] == [False]


def test_dry_run(spark):
    df = files(spark, video(1, "hevc", 3000), video(2, "h264", 3000), video(3, "h264", 9000), video(4, "hevc", 3000, status="Completed"), video(5, "hevc", 5000), video(6, "h264", 20000, 3840), video(7, "hevc", 4300))
    rows = {r["id"]: tuple(r["d"]) for r in df.select("id", D.dry_run_video(D.Options(), F.lit(False)).alias("d")).collect()}
    assert rows[1][0] == "Skip" and rows[2] == ("Shrink", 2100, False) and rows[3] == ("Queue", 3500, False) and rows[4][0] == "AlreadyCompleted"
    assert rows[5] == ("Queue", 3500, True) and rows[6] == ("Queue", 14000, False) and rows[7][2] is True
    forced = df.select("id", D.dry_run_video(D.Options(), F.lit(False), F.lit("TranscodeWithProfile"), None, F.lit(1234)).alias("d")).where("id = 1").first()["d"]
    assert (forced["decision"], forced["target"]) == ("Queue", 1234)


def test_music(spark):
    df = files(spark, video(1, "mp3", 192, kind="Music"), video(2, "aac", 200, kind="Music"), video(3, "aac", 300, kind="Music"), video(4, "flac", 900, kind="Music"))
    got = lambda o: [r["d"]["decision"] for r in df.select("id", D.dry_run_music(o).alias("d")).orderBy("id").collect()]
    assert got(D.MusicOptions()) == ["Queue", "Skip", "Queue", "Queue"]
    assert got(D.MusicOptions("flac", "flac")) == ["Skip", "Skip", "Skip", "Skip"]
    assert got(D.MusicOptions("mp3", "libmp3lame", 192))[0] == "Queue"  # the encoder's name isn't the codec's


def test_intake(spark):
    df = files(spark, video(1, "hevc", 1, status="Failed", failures=1), video(2, "mp3", 1, status="Failed", failures=2, kind="Music"), video(3, "h264", 1, status="Completed"))
    ask = lambda same, changed: [r["d"] for r in df.select("id", D.intake(D.Options(), F.lit(False), F.lit(same), F.lit(changed)).alias("d")).orderBy("id").collect()]
    assert ask(True, False) == ["Unchanged"] * 3
    assert ask(False, False) == ["Failed", "Queue", "Known"]
    assert ask(False, True) == ["Skip", "Queue", "Queue"]


def test_keep(spark):
    reason = lambda *a: one(spark, D.keep_output(F.lit(a[0]), F.lit(a[1]), F.lit(a[2]), a[3], F.lit(a[4])))["reason"]
    assert reason(10, 9, False, False, False) == "savings" and reason(10, 10, False, False, False) == "no savings"
    assert reason(10, 11, False, True, False) == "configured audio outputs" and reason(10, 11, True, True, True) == "profile retention policy"


LEDGER = "job_key long, line_no int, part_key long, node_key long, original_size_bytes long, encoded_size_bytes long, bytes_saved long, duration_seconds long, encode_seconds long, device_id string, kind string, is_4k boolean, outcome string, completed_at timestamp_ntz, profile_name string, profile_id string"


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], LEDGER)
    assert set(ledger.summary(empty).first()) == {0}
    assert ledger.savings_over_time(empty, 7, "2024-01-10").count() == 7
    assert ledger.measured_profiles(empty).count() == 0 and tuple(ledger.savings_ratio(empty).first()) == (0, 0)
    assert ledger.outcome_pies(empty, drop_zero=True).count() == 0


def test_measured(spark):
    import datetime

    t = datetime.datetime
    row = lambda k, a, b, s, id_, day: (k, 1, 1, 1, a, b, a - b if b else 0, s, s, "gpu", "Video", True, "Completed", t(2024, 1, day), "AV1 4K", id_)
    df = spark.createDataFrame([row(1, 50 * 10**9, 10 * 10**9, 8000, "old", 1), row(2, 40 * 10**9, 8 * 10**9, 8000, "new", 2), row(3, 4 * 10**9, 0, 100, "mid", 1)], LEDGER)
    r = ledger.measured_profiles(df).first()
    assert (r["jobs"], r["kept"], r["discarded"], r["bytes_saved"], r["kbps"], r["profile_id"]) == (3, 2, 1, 72 * 10**9, 9000, "new")


def test_queue_order_and_page(spark):
    import datetime

    t = datetime.datetime
    rows = [(i, f"/q/{i}", "Video", 0, 1000 + i, t(2024, 1, 1 + i), "Queued", None) for i in range(7)] + [(8, "/q/front", "Music", 5, 500, t(2024, 1, 1), "Queued", None), (9, "/q/remote", "Video", 9, 1, t(2024, 1, 1), "Queued", "n"), (10, "/q/done", "Video", 9, 1, t(2024, 1, 1), "Completed", None)]
    df = spark.createDataFrame(rows, "id long, file_path string, kind string, priority int, bitrate long, created_at timestamp, status string, assigned_node_id string")
    assert [r["id"] for r in queue.page(df, 0, 3).collect()] == [8, 6, 5]
    assert [r["bitrate"] for r in queue.page(df, 2, 3, kind="Video").collect()] == [1004, 1003, 1002] and queue.page(df, 0, 0).count() == 0
    assert queue.total(df, "Video").first()[0] == 7
    assert {r["id"]: r["priority"] for r in queue.bump(df, df.where("id = 3")).collect()}[3] == 10
    window = queue.window(df, size=4, floor=1)
    assert {r["id"] for r in window.collect()} == {8, 6, 5, 4}


def test_queue_window_keeps_a_floor(spark):
    rows = [(i, f"/v/{i}", "Video", 1, 9000 - i) for i in range(60)] + [(100 + i, f"/m/{i}", "Music", 0, 100 + i) for i in range(20)]
    df = spark.createDataFrame([(*r, "Queued", None) for r in rows], "id long, file_path string, kind string, priority int, bitrate long, status string, assigned_node_id string")
    got = queue.window(df)
    assert got.count() == 50 and {r["id"] for r in got.where("kind = 'Music'").collect()} == {112 + i for i in range(8)}


def test_scan_predicates(spark):
    assert one(spark, scan.drift(F.lit(100), F.lit(109))) is False and one(spark, scan.drift(F.lit(100), F.lit(111))) is True and one(spark, scan.drift(F.lit(0), F.lit(5))) is False
    assert one(spark, scan.file_changed(F.lit(1), F.lit(1), F.lit(10), F.lit(41))) is True


def test_scores_prefer_older_heartbeats(spark):
    items = spark.createDataFrame([("i", 10, False, "hevc", "auto", "")], "item_id string, size long, is_4k boolean, codec string, hardware string, encoder string")
    nodes = spark.createDataFrame([(n, "worker", "Online", False, 10**6, False, False, r) for n, r in (("a", 2), ("b", 1))], "node_id string, role string, status string, is_paused boolean, available_disk_bytes long, only_4k boolean, exclude_4k boolean, heartbeat_rank long")
    devices = spark.createDataFrame([(n, d, "h264,h265", "x", c) for n in "ab" for d, c in (("cpu", 5), ("nvidia", 2))], "node_id string, device_id string, codecs string, encoders string, capacity int")
    slots = spark.createDataFrame([], "job_id string, node_id string, device_id string, phase string, progress int")
    scores = placement.video_scores(items, nodes, devices, slots)
    assert {(r["device_id"], r["score"]) for r in scores.collect()} == {("cpu", -50), ("nvidia", 11)}
    assert tuple(placement.best_slots(scores).first()) == ("i", "b", "nvidia", 11)


def test_ocr(spark):
    assert one(spark, ocr.substituted(F.lit("=Well, | am here\n= [1] -| x"))) == "-Well, I am here\n- [1] -I x"
    ranks = spark.createDataFrame([("and", 3), ("hello", 10), ("hallo", 900), ("world", 20), ("look", 30), ("did", 40), ("aid", 700), ("what", 5), ("they", 6), ("ships", 9000), ("ship", 50), ("then", 200), ("rnan", 99_000), ("man", 60), ("don't", 70), ("rare", 450)], "word string, rank int")
    pairs = spark.createDataFrame([("what", "did"), ("did", "they")], "a string, b string")
    wanted = {
        "hcllo w0rld": "hello world",  # an unknown word becomes its best neighbour, digits are read as letters
        "Hcllo WORLB": "Hello WORLB",  # the case stays, capitals are left alone
        "and Hcllo": "and Hcllo",  # a capitalised word inside a sentence is a name
        "so. Hcllo": "so. Hello",
        "1oo8 100K 8100": "1oo8 look 8100",
        "what aid they": "what did they",  # a known word gives way where the words beside it speak for another
        "the aid": "the did",  # or where the other is more frequent by far
        "hallo rare": "hello rare",  # but not on little evidence
        "ships": "ships",  # nor another length without a pair that speaks for it
        "thne": "then",
        "d0n't": "don't",
        "ab hx": "ab hx",
    }
    lines = spark.createDataFrame([(k, i) for i, k in enumerate([*wanted, *wanted, None, ""])], "text string, new int")
    got = ocr.corrected(lines.withColumnRenamed("new", "n"), "text", ranks, pairs).collect()
    assert len(got) == 2 * len(wanted) + 2 and {r["text"]: r["corrected"] for r in got} == {**wanted, None: None, "": ""}
    assert {tuple(r) for r in ocr.word_ranks(spark.createDataFrame([("b a a A c1",), ("B c d",)], "t string"), "t").collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    assert [tuple(r) for r in ocr.word_pairs(spark.createDataFrame([("x y x y",), ("y",), (None,)], "t string"), "t").collect()] == [("x", "y")]


def test_ocr_correct_of_letters_that_case_changes_by_more_than_one(spark, tmp_path):
    import duckdb

    from framelake.queries import ORACLES, QUERIES

    texts = ["\u00dfaba zoro luma"] * 5 + ["E\u00dfaba zoro luma. A\u00dfba zoro"]
    texts += ["\u0130zmir \u039b\u039f\u0393\u039f\u03a3 \u03bb\u03bf\u03b3\u03bf\u03c2 \u0130zmir izmr", "a \x0b| b", "| |\u2028", "say |\x85", "| | |\n"]
    rows = [(i, t, "user", s) for i, s in enumerate(texts) for t in (0, 1)] + [(None, 0, "user", "zoroa luma"), (99, None, "user", "zorob luma"), (98, 0, "user", "zoroc luma")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("ocr_correct", "ocr_substitutions"):
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(ORACLES[name]).fetchall()))
    made = {(r[0], r[1]): r[2] for r in QUERIES["ocr_correct"](spark, str(tmp_path)).collect()}
    assert made[(5, 0)].startswith("\u1e9eaba zoro luma.") and made[(98, 0)] == "zoro luma" and made[(None, 0)] == "zoroa luma"


def test_ocr_sends_words_without_their_lines(spark, monkeypatch):
    """Lines of two thousand words: what is shuffled grows with the words, not with the words times their line."""

    def shuffled():
        told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))

    pick = random.Random(7)
    known = ["".join(pick.choice("aeioulnrst") for _ in range(pick.randint(4, 7))) for _ in range(600)]
    misread = lambda w: w.replace("o", "c", 1) if pick.random() < 0.2 else w
    texts = [" ".join(misread(pick.choice(known)) for _ in range(2000)) for _ in range(10)]
    lines = spark.createDataFrame([(t,) for t in texts], "text string")
    ranks = spark.createDataFrame([(w, i) for i, w in enumerate(dict.fromkeys(known))], "word string, rank int")
    pairs = spark.createDataFrame([(a, b) for a, b in zip(known[::3], known[1::3], strict=False)], "a string, b string")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as in large tables
    before = shuffled()
    got = {r["text"]: r["corrected"] for r in ocr.corrected(lines, "text", ranks, pairs).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert 0 < shuffled() - before < 60 * sum(map(len, texts))
    assert set(got) == set(texts) and all(len(a.split()) == len(b.split()) for a, b in got.items()) and any(a != b for a, b in got.items())
    monkeypatch.setattr(ocr, "FEW_COMMON", 0)  # as where too many words are common to be sent to all
    assert {r["text"]: r["corrected"] for r in ocr.corrected(lines, "text", ranks, pairs).collect()} == got


def test_sources(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for n in ("a/x.mkv", "a/b/y.FLAC", "a/z.txt", "a/x [encoded].mkv"):
        (tmp_path / n).write_bytes(b"123")
    rows = {r["base_name"]: (r["kind"], r["size"]) for r in FS.listing(spark, str(tmp_path / "a")).collect()}
    assert rows == {"x": ("Video", 3), "y": ("Music", 3)}
    (tmp_path / "s.json").write_text("{broken")
    (tmp_path / "s.json.bak").write_text(json.dumps({"k": 1}))
    assert FS.settings(spark, str(tmp_path / "s.json")) == {"k": 1} and FS.settings(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "log.txt").write_text("\n".join(map(str, range(10))))
    assert [r["value"] for r in FS.log_tail(spark, str(tmp_path / "log.txt"), 3).collect()] == ["7", "8", "9"]


def test_probe_and_subtitles(spark):
    text = json.dumps({"streams": [{"codec_type": "video", "color_primaries": "BT2020"}, {"codec_type": "audio", "codec_name": "aac", "channels": 2, "tags": {"language": "eng"}}, {"codec_type": "subtitle", "codec_name": "ass", "tags": {"title": "English SDH"}}], "format": {"duration": "12.5", "bit_rate": "256999"}})
    p = FS.probe(F.lit(text))
    assert one(spark, M.hdr_any(p["streams"])) is True and one(spark, M.hdr_first(p["streams"])) is False and one(spark, FS.best_duration(p)) == 12.5 and one(spark, FS.source_kbps(p)) == 256
    a, b = A.summaries(p["streams"])
    assert one(spark, a)[0]["l"] == "eng" and one(spark, b)[0]["s"] is True
    cues = spark.createDataFrame([("f", 3_723_004, 3_724_000, " hi "), ("f", 0, 900, "first"), ("f", 5, 6, "  ")], "f string, start_ms long, end_ms long, text string")
    srt = FS.srt(cues, "f").first()["srt"]
    assert srt == "1\n00:00:00,000 --> 00:00:00,900\nfirst\n\n2\n01:02:03,004 --> 01:02:04,000\nhi\n"
    assert [c["text"] for c in one(spark, FS.parse_srt(F.lit(srt)))] == ["first", "hi"]
    assert one(spark, FS.black_seconds(F.lit("black_duration:1.5 x black_duration: 2"))) == 3.5
    assert one(spark, FS.original_language(F.lit('{"originalLanguage": {"name": "Japanese"}}'))) == "Japanese" and one(spark, FS.original_language(F.lit('{"originalLanguage": "ja"}'))) == "ja"


def test_drained_rows_are_in_the_shared_folder(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(i % 2, i, "2024-01-01 00:00:00"), (7, i, "2024-01-01 00:00:00")], "k int, n int, t string").coalesce(1).write.mode("append").parquet(str(source))
    stream = feeds.open_stream(spark, str(source), "t", files_per_trigger=1)
    found = feeds.drained(feeds.latest(stream, "k", "n", "n"), "drained_test")
    assert {tuple(r) for r in found.collect()} == {(0, 2, 2), (1, 1, 1), (7, 2, 3)}
    shared = spark.conf.get("spark.checkpoint.dir")
    assert found.inputFiles() and all(shared in f for f in found.inputFiles())
    assert list(Path(shared).glob("drained_test-*/state/state"))
    every = feeds.drained(feeds.open_stream(spark, str(source), "t", files_per_trigger=1), "drained_rows", "append")
    assert every.columns == ["k", "n", "t"] and every.count() == 6


def test_push_is_resumable(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, "2024-01-01 00:00:00")], "n int, t string").write.parquet(str(source))
    for more in (False, True):
        if more:
            spark.createDataFrame([(2, "2024-01-02 00:00:00")], "n int, t string").write.mode("append").parquet(str(source))
        feeds.push(feeds.open_stream(spark, str(source), "t"), feeds.append_to(str(out)), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(str(out)).collect()) == [1, 2]


@pytest.mark.parametrize(
    ("plan", "reason"),
    [
        ((2, None, "skip", None, None, None, None), "protocol not supported"),
        ((1, "x", "skip", None, None, None, None), "blocked: x"),
        ((1, None, "skip", None, None, None, None), "skip must not be dispatched"),
        ((1, None, "mux_only", None, None, None, None), "mux plan needs mux options"),
        ((1, None, "use_simple", None, None, None, None), None),
        ((1, None, "transcode_with_profile", "a", None, None, None), "profile missing"),
        ((1, None, "transcode_with_profile", "a", "b", None, None), "profile mismatch"),
        ((1, None, "transcode_with_profile", "a", "a", None, "libx265"), "encoder mismatch"),
        ((1, None, "transcode_with_profile", "a", "a", "hevc_qsv", "HEVC_QSV"), "options mismatch"),
        ((1, None, "transcode_with_profile", "a", "a", "libx265", "LIBX265"), None),
    ],
)
def test_worker_contract(spark, plan, reason):
    df = spark.createDataFrame([(plan,)], "p struct<protocol:int,blocked:string,action:string,profile_id:string,resolved_id:string,encoder:string,profile_encoder:string>")
    assert df.select(D.worker_problem(F.col("p"), D.Options()).alias("x")).first()["x"] == reason


def test_small_helpers(spark):
    from framelake.functions import text as X

    assert one(spark, X.spaced(F.lit("EncodeCompletedNow"))) == "Encode Completed Now"
    assert one(spark, X.shortened(F.lit("abcdef"), 5)) == "ab..." and one(spark, X.shortened(F.lit("abc"), 5)) == "abc"
    assert [one(spark, X.channel(F.lit(u))) for u in ("Apprises://x", "https://ntfy.sh/a", "https://h/x")] == ["apprise", "ntfy", "webhook"]
    assert [one(spark, X.number(F.lit(v))) for v in (1.5, 2.0, 0.1234567)] == ["1.5", "2", "0.123457"]
    assert M.best_quality({20: 5000, 24: 3400, 28: 2000}, 3000, 0.2) == 24 and M.best_quality({20: 9000, 24: 5000}, 3000, 0.1) == 24
    assert [one(spark, M.display_bytes(F.lit(v))) for v in (0, 9, 1029, 1030, 10_240, 1_027_891, 1024**3 * 1024, 5 * 1024**5)] == ["0 B", "9.00 B", "1.00 KB", "1.01 KB", "10.0 KB", "1004 KB", "1.00 TB", "5.00 PB"]
    assert [one(spark, M.log_bytes(F.lit(v))) for v in (0, 9, 1536, 1024 * 100, 3 * 1024**4 + 1024**3 * 256)] == ["0 Bytes", "9 Bytes", "1.5 KB", "100 KB", "3.25 TB"]
    assert one(spark, placement.music_score(F.lit(3), F.lit(True))) == 70
    assert one(spark, FS.escaped(F.lit('a"b\\c'))) == 'a\\"b\\\\c'
    assert [one(spark, placement.capacity(F.lit(d), F.lit(3))) for d in ("cpu", "gpu")] == [1, 3]


def test_changes(spark):
    import datetime

    rows = [(1, "/a/x.mkv", "Queued", "ok", 2, None), (2, "/a/y.mkv", "Processing", "bad", 0, "n"), (3, "/a/z.mkv", "Processing", None, 0, None)]
    df = spark.createDataFrame(rows, "id long, file_path string, status string, last_verify_result string, failure_count int, assigned_node_id string").withColumn("failure_reason", F.lit(None).cast("string")).withColumn("priority", F.lit(4))
    failures = spark.createDataFrame([("/a/x.mkv", "y", 1), ("/a/x.mkv", "x" * 3000, 2), ("/b", "z", 1)], "path string, reason string, at int")
    failed = {r["id"]: (r["status"], r["failure_count"], r["failure_reason"]) for r in scan.record_failures(df, failures).collect()}
    assert failed[1] == ("Failed", 4, "x" * 2048) and failed[2] == ("Processing", 0, None) and len(failed) == 3
    assert {r["id"]: r["status"] for r in scan.requeue_orphans(df).collect()} == {1: "Queued", 2: "Processing", 3: "Queued"}
    assert {(r["status"], r["priority"], r["assigned_node_id"]) for r in scan.reset_all(df).collect()} == {("Unseen", 4, None)}
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", True), (2, 3, "a", False)], "work_item_id long, id long, phase string, completed boolean")
    assert {r["work_item_id"]: r["phase"] for r in scan.latest_transition(log).collect()} == {1: "b", 2: "a"} and scan.open_transitions(log).count() == 2
    nodes = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1, 0, 0)), ("b", datetime.datetime(2024, 1, 1, 0, 9))], "node_id string, last_heartbeat timestamp_ntz")
    assert [r["node_id"] for r in placement.silent(nodes, F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")).collect()] == ["a"]


def test_scores_of_all_pairs_are_dealt_to_tasks_of_few_places(spark, monkeypatch):
    """Classes are found before items are dealt to thousands of parts, and no task holds all places."""
    from framelake.queries import _items, view

    ended = lambda: (lambda told: sum(told.apply(i).totalTasks() for i in range(told.size())))(spark.sparkContext._jsc.sc().statusStore().executorList(False))
    d = "/root/testdata/sf0.001"
    tables = _items(spark, d), *[view(spark, d, v) for v in ("nodes", "devices", "slots")]
    wanted = sorted(map(tuple, placement.video_scores(*tables).select("item_id", "node_id", "device_id", "score").collect()))
    monkeypatch.setattr(placement, "PAIRS", 3)
    before = ended()
    scores = placement.all_scores(*tables)
    assert ended() - before < len(wanted) / 30
    assert sorted(map(tuple, scores.collect())) == wanted
    monkeypatch.setattr(placement, "PLACES", 5)
    cut = placement.all_scores(*tables)
    assert sorted(map(tuple, cut.collect())) == wanted and cut.rdd.getNumPartitions() % -(-view(spark, d, "devices").count() // 5) == 0
    monkeypatch.undo()
    n, m = 1_190_000, 105_000  # sixty copies of sf0.1
    beside, parts = placement.dealt(n, m)
    assert m / beside <= placement.PLACES and beside * parts < 100_000 and placement.dealt(0, 0) == (1, 1)
