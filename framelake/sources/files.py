"""Sources and sinks around the library: listings, probes, settings, logs, subtitles, metrics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import paths as P
from framelake.functions import schedule as S

PROBE = """streams array<struct<index:int,codec_type:string,codec_name:string,duration:string,bit_rate:string,width:int,height:int,channels:int,channel_layout:string,avg_frame_rate:string,r_frame_rate:string,color_transfer:string,color_primaries:string,pix_fmt:string,tags:struct<language:string,title:string>,disposition:struct<default:int,forced:int,hearing_impaired:int>>>, format struct<duration:string,size:string,bit_rate:string>"""


def listing(spark: SparkSession, folder: str, marker: str = "[encoded]") -> DataFrame:
    """Media files below a folder: path, directory, base_name, kind, size, modified_at. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    c = F.col("path")
    return files.select(c, P.directory(c).alias("directory"), P.base_name(c).alias("base_name"), P.kind(c, marker).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")).where("kind is not null")


def probe(text: Column) -> Column:
    """A probe document; null if it is malformed."""
    return F.from_json(text, PROBE)


def best_duration(p: Column) -> Column:
    """The longer of the container's and the first video stream's lengths, in seconds."""
    first = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), 0)
    return F.when(first.isNull(), F.lit(0.0)).otherwise(F.greatest(S.seconds(p["format"]["duration"]), S.seconds(first["duration"])))


def source_kbps(p: Column) -> Column:
    """Kbps of the first audio stream, else of the container, else 0."""
    rate = lambda x: F.when(x.try_cast("long") > 0, x.try_cast("long"))
    stream = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), 0)
    return F.floor(F.coalesce(rate(stream["bit_rate"]), rate(p["format"]["bit_rate"]), F.lit(0)) / 1000).cast("long")


def settings(spark: SparkSession, path: str) -> dict:
    """A JSON settings document, or its backup beside it if the document is missing or malformed; else empty."""
    for name in (path, path + ".bak"):
        try:
            text = "\n".join(r["value"] for r in spark.read.text(name, wholetext=True).collect())
            found = json.loads(text)
            if isinstance(found, dict):
                return found
        except Exception as e:  # a missing file is Spark's exception, a malformed one JSON's
            if not isinstance(e, ValueError) and "PATH_NOT_FOUND" not in str(e):
                raise
    return {}


def watched_folders(text: Column) -> Column:
    """Watched folders from JSON: each is a path or an object with one."""
    raw = F.from_json(text, "array<string>")
    return F.transform(raw, lambda x: F.coalesce(F.get_json_object(x, "$.path"), x))


def original_language(text: Column) -> Column:
    """The original language of a catalog entry: an object with a name, or the name."""
    value = F.get_json_object(text, "$.originalLanguage")
    return F.coalesce(F.get_json_object(value, "$.name"), value)


#: Bytes at the end of a log that are read first; twice as many each time that they hold too few lines.
TAIL = 65_536


def log_tail(spark: SparkSession, path: str, lines: int, block: int = TAIL) -> DataFrame:
    """(line, value): the last lines of a log in order, counted from 0 at the first of them. Only the end of the file is
    read, so a long log costs no more than a short one. An end of line at the very end begins no line."""
    if lines <= 0:
        return spark.createDataFrame([], "line long, value string")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(where).getLen()
    data = b""
    while len(data) < size and data[:-1].count(b"\n") < lines:
        want = min(size, max(block, 2 * len(data)))
        with_start = fs.open(where)
        try:
            with_start.seek(size - want)
            data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(with_start, want))
        finally:
            with_start.close()
    rows = data.removesuffix(b"\n").split(b"\n")[-lines:] if data else []
    text = [r.removesuffix(b"\r").decode("utf-8", "replace") for r in rows]
    return spark.createDataFrame(list(enumerate(text)), "line long, value string")


def newest_log(files: DataFrame, prefix: str) -> DataFrame:
    """The newest of the logs (name, modified_at) with a prefix."""
    return files.where(F.col("name").startswith(prefix) & F.col("name").endswith(".log")).orderBy(F.desc("modified_at"), "name").limit(1)


def expired_logs(files: DataFrame, now: Column, days: int, keep: str = "current-") -> DataFrame:
    """Log files (name, modified_at) older than so many days, without the ones in use."""
    return files.where((F.col("modified_at") < now - F.make_interval(days=F.lit(days))) & ~F.col("name").startswith(keep))


def benign(line: Column) -> Column:
    """Decoder messages that don't tell of damage."""
    return F.lower(line).contains("non monotonically increasing dts to muxer")


def stamp(ms: Column) -> Column:
    """Milliseconds as a subtitle's time."""
    n = ms.cast("long")
    pad = lambda x, w: F.lpad(x.cast("string"), w, "0")
    return F.concat(pad(F.floor(n / 3600000), 2), F.lit(":"), pad(F.floor(n / 60000) % 60, 2), F.lit(":"), pad(F.floor(n / 1000) % 60, 2), F.lit(","), pad(n % 1000, 3))


def pts_ms(ticks: Column) -> Column:
    """Milliseconds of a 90 kHz clock."""
    return F.floor(ticks / 90).cast("long")


def srt(cues: DataFrame, by: str) -> DataFrame:
    """Cues (by, start_ms, end_ms, text) as one subtitle text for each `by`: numbered by start, blank cues left out."""
    rows = cues.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text"))).alias("cues"))
    block = F.transform("cues", lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), stamp(c["start_ms"]), F.lit(" --> "), stamp(c["end_ms"]), F.lit("\n"), F.trim(c["text"]), F.lit("\n")))
    return rows.select(by, F.array_join(block, "\n").alias("srt"))


def parse_srt(text: Column) -> Column:
    """array<struct<start, end, text>> of a subtitle text."""
    blocks = F.filter(F.split(F.regexp_replace(text, "\r", ""), r"\n\s*\n"), lambda b: b.rlike("-->"))
    part = lambda b, n: F.regexp_extract(b, r"(?s)(\d+:\d+:\d+,\d+)\s*-->\s*(\d+:\d+:\d+,\d+)\n?(.*)", n)
    return F.transform(blocks, lambda b: F.struct(part(b, 1).alias("start"), part(b, 2).alias("end"), F.regexp_replace(part(b, 3), r"^\s+|\s+$", "").alias("text")))


def escaped(label: Column) -> Column:
    return F.replace(F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def metrics_text(metrics: DataFrame) -> DataFrame:
    """Lines of the text exposition from (name, kind, help, label, label_value, value): a head for each name, then its
    samples."""
    sample = F.concat("name", F.when(F.col("label").isNotNull(), F.concat(F.lit("{"), "label", F.lit('="'), escaped(F.coalesce("label_value", F.lit(""))), F.lit('"}'))).otherwise(F.lit("")), F.lit(" "), F.col("value").cast("string"))
    rows = metrics.groupBy("name").agg(F.first("kind").alias("kind"), F.first("help").alias("help"), F.array_sort(F.collect_list(sample)).alias("samples"))
    return rows.select("name", F.array_join(F.concat(F.array(F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind")), "samples"), "\n").alias("text"))


def envelope(rows: DataFrame, total: DataFrame, page: int, size: int) -> DataFrame:
    """A page of records as one JSON document, with the number of all records, the one row of `total`. The page is
    bounded by its size."""
    records = rows.limit(size).agg(F.collect_list(F.struct(*rows.columns)).alias("records"))
    both = records.crossJoin(F.broadcast(total.toDF("total")))  # one row each
    return both.select(F.to_json(F.struct(F.lit(page).alias("page"), F.lit(size).alias("pageSize"), "total", "records")).alias("json"))


def transition_sink(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def black_seconds(log: Column) -> Column:
    """Seconds of blackness that a filter's log tells of."""
    found = F.regexp_extract_all(log, F.lit(r"black_duration:\s*([0-9.]+)"))
    return F.aggregate(found, F.lit(0.0), lambda a, x: a + F.coalesce(x.try_cast("double"), F.lit(0.0)))


def crop_mode(crops: DataFrame) -> DataFrame:
    """The most frequent crop of each file (file_id, crop); on ties the least by name."""
    n = crops.groupBy("file_id", "crop").agg(F.count("*").alias("n"))
    return n.groupBy("file_id").agg(F.min_by("crop", F.struct(-F.col("n"), F.col("crop"))).alias("crop"))
