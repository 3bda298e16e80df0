"""Audio and subtitle work, from the stream summaries of a file."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions import language as L

AUDIO = "array<struct<l:string,c:string,ch:int,t:string>>"
SUBTITLE = "array<struct<l:string,c:string,t:string,s:boolean>>"
# Subtitle codecs that are pictures; channels of layouts; quality of audio codecs.
BITMAP = ("hdmv_pgs_subtitle", "pgssub", "dvd_subtitle", "dvdsub", "dvb_subtitle", "dvbsub", "xsub")
CHANNELS = {"mono": 1, "stereo": 2, "5.1": 6, "7.1": 8}
QUALITY = {
    **dict.fromkeys(("flac", "truehd", "mlp", "alac", "pcm_s16le", "pcm_s24le"), 4),
    **dict.fromkeys(("dts", "dtshd"), 3),
    **dict.fromkeys(("eac3", "ac3"), 2),
    **dict.fromkeys(("aac", "opus", "vorbis", "mp3"), 1),
}


@dataclass(frozen=True)
class AudioOutput:
    codec: str
    layout: str | None = None
    kbps: int = 192


@dataclass(frozen=True)
class StreamOptions:
    audio_languages: tuple[str, ...] = ()
    subtitle_languages: tuple[str, ...] = ()
    preserve_original_audio: bool = True
    audio_outputs: tuple[AudioOutput, ...] = field(default_factory=tuple)
    exclude_sdh: bool = False
    extract_sidecar: bool = False
    convert_images: bool = False
    pass_images_mkv: bool = True
    format: str = "mkv"


def audio(text: Column) -> Column:
    """Audio summaries of a JSON column; none if it is null, empty or malformed."""
    return F.coalesce(F.from_json(text, AUDIO), F.array().cast(AUDIO))


def subtitles(text: Column) -> Column:
    return F.coalesce(F.from_json(text, SUBTITLE), F.array().cast(SUBTITLE))


def summaries(streams: Column) -> tuple[Column, Column]:
    """Audio and subtitle summaries of a probe's streams."""
    a = F.transform(F.filter(streams, lambda s: s["codec_type"] == "audio"), lambda s: F.struct(s["tags"]["language"].alias("l"), s["codec_name"].alias("c"), s["channels"].alias("ch"), s["tags"]["title"].alias("t")))
    sdh = lambda s: (F.coalesce(s["disposition"]["hearing_impaired"], F.lit(0)) == 1) | L.is_sdh(s["tags"]["title"])
    b = F.transform(F.filter(streams, lambda s: s["codec_type"] == "subtitle"), lambda s: F.struct(s["tags"]["language"].alias("l"), s["codec_name"].alias("c"), s["tags"]["title"].alias("t"), sdh(s).alias("s")))
    return a, b


def with_original(wanted: tuple[str, ...], original: str | None) -> tuple[str, ...]:
    """The keep list with the original language, unless nothing is wanted or it is there already."""
    return wanted if not wanted or not original or original.lower() in {w.lower() for w in wanted} else (*wanted, original)


def _once(value: Column, then) -> Column:
    """`then(value)` with `value` evaluated once a row, as it may be the parse of a document."""
    return F.element_at(F.transform(F.array(value), then), 1)


def has_audio_work(streams: Column, o: StreamOptions) -> Column:
    """Whether audio mapping would change anything: a track goes, moves, is a commentary, or an output isn't there."""
    return _once(streams, lambda s: _audio_work(s, o))


def _audio_work(streams: Column, o: StreamOptions) -> Column:
    wanted = list(o.audio_languages)
    kept = F.filter(streams, lambda s: L.matches(s["l"], s["t"], wanted)) if wanted else streams
    work = F.size(kept) < F.size(streams)
    if wanted:
        work = work | L.would_reorder(F.transform(kept, lambda s: s["l"]), wanted)
    work = work | F.exists(kept, lambda s: L.is_commentary(s["t"]))
    if not o.preserve_original_audio:
        if o.audio_outputs:
            work = work | F.lit(True)
        else:
            langs = F.transform(kept, lambda s: F.lower(F.coalesce(s["l"], F.lit("und"))))
            work = work | (F.size(F.array_distinct(langs)) < F.size(langs))
    for out in o.audio_outputs if o.preserve_original_audio else ():
        n = CHANNELS.get((out.layout or "").strip().lower())
        work = work | ~F.exists(kept, lambda s: (F.lower(F.coalesce(s["c"], F.lit(""))) == out.codec.lower()) & (F.lit(True) if n is None else F.coalesce(s["ch"] == n, F.lit(False))))  # noqa: B023
    return (F.size(streams) > 0) & F.coalesce(work, F.lit(False))


def has_subtitle_work(streams: Column, o: StreamOptions) -> Column:
    """Whether subtitle mapping would change anything."""
    return _once(streams, lambda s: _subtitle_work(s, o))


def _subtitle_work(streams: Column, o: StreamOptions) -> Column:
    wanted = list(o.subtitle_languages)
    kept = F.filter(streams, lambda s: L.matches(s["l"], s["t"], wanted)) if wanted else streams
    work = F.size(kept) < F.size(streams)
    if o.exclude_sdh:
        work = work | F.exists(streams, lambda s: F.coalesce(s["s"], F.lit(False)))
    if wanted:
        work = work | L.would_reorder(F.transform(kept, lambda s: s["l"]), wanted)
    if o.extract_sidecar:
        work = work | (F.size(kept) > 0)
    if o.convert_images or (o.format.lower() in ("mkv", "matroska") and not o.pass_images_mkv):
        work = work | F.exists(kept, lambda s: F.coalesce(F.lower(s["c"]).isin(*BITMAP), F.lit(False)))
    return (F.size(streams) > 0) & F.coalesce(work, F.lit(False))


def best_source(streams: Column, channels: int) -> Column:
    """The stream from which to make an output: enough channels, then most of them, then the best codec."""
    quality = F.create_map(*[F.lit(x) for pair in QUALITY.items() for x in pair])
    rank = lambda s: F.struct(s["ch"].alias("ch"), F.coalesce(F.try_element_at(quality, F.lower(s["c"])), F.lit(0)).alias("q"))
    fit = F.transform(F.filter(streams, lambda s: s["ch"] >= channels), lambda s: F.struct(rank(s).alias("r"), s["l"].alias("l"), s["c"].alias("c"), s["ch"].alias("ch"), s["t"].alias("t")))
    return F.array_max(fit)


# Audio codecs that can be made, with their most channels; which of them containers hold, and which
# codecs containers take as they are.
MOST_CHANNELS = {"aac": 8, "ac3": 6, "eac3": 8, "opus": 8}
HELD = {"mp4": ("aac", "ac3", "eac3"), "webm": ("opus",)}
COPIED = {"mp4": ("aac", "ac3", "eac3", "mp3", "alac"), "webm": ("opus", "vorbis")}

_STEP = "array<struct<bucket:string,action:string,source:int,codec:string,channels:int,kbps:int>>"


def _container(format_: str) -> str:
    name = format_.strip().lower()
    return {"m4v": "mp4", "mov": "mp4"}.get(name, name)


def _made(codec: str, container: str) -> str:
    """The codec that an output gets: what is asked for if it can be made and the container holds it."""
    held = HELD.get(container, tuple(MOST_CHANNELS))
    return codec if codec in MOST_CHANNELS and codec in held else "opus" if container == "webm" else "aac"


def audio_buckets(streams: Column, wanted: tuple[str, ...]) -> Column:
    """array<struct<bucket, sources>>: tracks by wanted language, or by their own tag if none is wanted; commentaries
    are left out. A file without a bucket has one of all its tracks, without commentaries if others are there."""
    indexed = F.transform(streams, lambda s, i: F.struct(i.cast("int").alias("i"), s["l"].alias("l"), s["c"].alias("c"), F.coalesce(s["ch"], F.lit(0)).alias("ch"), s["t"].alias("t")))
    real = F.filter(indexed, lambda s: ~L.is_commentary(s["t"]))
    of = lambda name, sources: F.struct(name.alias("bucket"), sources.alias("sources"))
    if wanted:
        among = lambda w: F.filter(real, lambda s: L.matches(s["l"], s["t"], [w]))
        found = F.array(*[of(F.lit(w), among(w)) for w in wanted])
        found = F.filter(found, lambda b: F.size(b["sources"]) > 0)
    else:
        tag = lambda s: F.lower(F.coalesce(s["l"], F.lit("und")))
        found = F.transform(F.array_distinct(F.transform(real, tag)), lambda name: of(name, F.filter(real, lambda s: tag(s) == name)))
    rest = F.when(F.size(real) > 0, real).otherwise(indexed)
    return F.when(F.size(found) > 0, found).when(F.size(streams) > 0, F.array(of(F.lit("und"), rest))).otherwise(F.slice(found, 1, 0))


def audio_plan(streams: Column, o: StreamOptions) -> Column:
    """What is written, in order: array<struct<output, bucket, action, source, codec, channels, kbps>>.

    In each bucket an output that a track already is copies that track, the one with most channels; else the best
    source with enough channels is encoded, and without one the output is left out. Copies come first, in order of
    their sources: those, and all tracks of the bucket if originals are kept. A bucket that would be empty keeps its
    track with most channels. What the container can't take as it is gets encoded, with kbps 0 for the codec's own
    default. If no track is in a wanted language, the tracks that are there are kept.
    """
    wanted, container = tuple(o.audio_languages), _container(o.format)
    takes = COPIED.get(container)
    quality = F.create_map(*[F.lit(x) for pair in QUALITY.items() for x in pair])
    lowered = lambda s: F.lower(F.coalesce(s["c"], F.lit("")))
    # the first of the best: more channels, then a better codec, then the earlier track
    best = lambda sources: F.array_max(F.transform(sources, lambda s: F.struct(s["ch"].alias("ch"), F.coalesce(F.try_element_at(quality, lowered(s)), F.lit(0)).alias("q"), (-s["i"]).alias("back"))))
    widest = lambda sources: F.array_max(F.transform(sources, lambda s: F.struct(s["ch"].alias("ch"), (-s["i"]).alias("back"))))
    step = lambda b, action, source, codec, channels, kbps: F.struct(b["bucket"].alias("bucket"), F.lit(action).alias("action"), source.cast("int").alias("source"), codec.alias("codec"), channels.cast("int").alias("channels"), F.lit(kbps).alias("kbps"))
    none = F.array().cast(_STEP)
    misses = ~F.exists(streams, lambda s: ~L.is_commentary(s["t"]) & L.matches(s["l"], s["t"], list(wanted))) if wanted else ~F.exists(streams, lambda s: ~L.is_commentary(s["t"]))

    def of(b: Column) -> Column:
        sources, copies, encodes = b["sources"], [], []
        for out in o.audio_outputs:
            if not out.codec.strip():
                continue
            n = CHANNELS.get((out.layout or "").strip().lower())
            same = F.filter(sources, lambda s: (lowered(s) == out.codec.lower()) & (F.lit(True) if n is None else s["ch"] == n))  # noqa: B023
            fit = best(F.filter(sources, lambda s: s["ch"] >= (n or 0)))  # noqa: B023
            codec = _made(out.codec.strip().lower(), container)
            channels = F.least(F.lit(n) if n else fit["ch"], F.lit(MOST_CHANNELS[codec]))
            copies.append(F.when(F.size(same) > 0, F.array(-widest(same)["back"])).otherwise(F.array().cast("array<int>")))
            encodes.append(F.when((F.size(same) == 0) & fit.isNotNull(), F.array(step(b, "encode", -fit["back"], F.lit(codec), channels, out.kbps))).otherwise(none))
        kept = F.flatten(F.array(*copies)) if copies else F.array().cast("array<int>")
        made = F.flatten(F.array(*encodes)) if encodes else none
        all_ = F.transform(sources, lambda s: s["i"])
        kept = F.when(F.lit(o.preserve_original_audio) | misses, F.array_union(kept, all_)).otherwise(kept)
        kept = F.when((F.size(kept) == 0) & (F.size(made) == 0), F.array(-widest(sources)["back"])).otherwise(F.array_distinct(kept))

        def copied(i: Column) -> Column:
            s = F.get(F.filter(sources, lambda x: x["i"] == i), 0)
            copy = step(b, "copy", i, s["c"], s["ch"], 0)
            if takes is None:
                return copy
            codec = _made("", container)
            return F.when(lowered(s).isin(*takes), copy).otherwise(step(b, "encode", i, F.lit(codec), F.least(s["ch"], F.lit(MOST_CHANNELS[codec])), 0))

        return F.concat(F.transform(F.array_sort(kept), copied), made)

    steps = F.flatten(F.transform(audio_buckets(streams, wanted), of))
    return F.transform(steps, lambda s, i: F.struct(i.alias("output"), *[s[c].alias(c) for c in ("bucket", "action", "source", "codec", "channels", "kbps")]))


def language_counts(streams: Column) -> Column:
    """array<struct<language, tracks>>: tracks of each language tag, lower case, `und` without one, in order of names."""
    tags = F.transform(streams, lambda s: F.lower(F.coalesce(s["l"], F.lit("und"))))
    return F.transform(F.array_sort(F.array_distinct(tags)), lambda name: F.struct(name.alias("language"), F.size(F.filter(tags, lambda t: t == name)).alias("tracks")))


def sidecars(streams: Column, o: StreamOptions) -> Column:
    """Text subtitles to extract, in order of the wanted languages: array of indexes."""
    wanted = [w.lower() for w in o.subtitle_languages]
    indexed = F.transform(streams, lambda s, i: F.struct(F.when(F.lit(bool(wanted)), F.array_position(F.array(*[F.lit(w) for w in wanted or [""]]), F.coalesce(L.two_letter(s["l"]), L.from_title(s["t"]), F.lit("")))).otherwise(F.lit(0).cast("long")).alias("rank"), i.alias("i"), s.alias("s")))
    fit = F.filter(indexed, lambda x: ~F.coalesce(F.lower(x["s"]["c"]).isin(*BITMAP), F.lit(False)) & L.matches(x["s"]["l"], x["s"]["t"], wanted) & ~(F.lit(o.exclude_sdh) & F.coalesce(x["s"]["s"], F.lit(False))))
    return F.transform(F.array_sort(F.transform(fit, lambda x: F.struct(x["rank"], x["i"]))), lambda x: x["i"])
