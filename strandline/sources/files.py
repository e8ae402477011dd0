"""Tables from label, dictionary, manifest and state files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = ("wav", "m4a", "mp3", "flac")
MANIFEST = "source struct<path:string,md5:string>, chunks array<struct<index:int,offset:double,duration:double,text:string>>"
STATE = "md5 string, output_key string, source_name string, source_path string, chunks int, labs int"


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def audio_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, content, md5, stem of audio files (suffix in any case); only the columns used are read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    d = d.where(F.lower(F.substring_index("path", ".", -1)).isin(*AUDIO))
    return d.select("path", "content", F.md5("content").alias("md5"), stem(F.col("path")).alias("stem"))


def whole_texts(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """stem, text of every file with the suffix, one row a file."""
    d = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(folder)
    return d.select(F.input_file_name().alias("path"), F.col("value").alias("text")).withColumn("stem", stem(F.col("path")))


def labelled_audio(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(audio with its .lab text, audio without): what has no label is kept apart, not dropped."""
    wav, lab = audio_files(spark, folder), whole_texts(spark, folder, ".lab").select("stem", F.trim("text").alias("label"))
    return wav.join(lab, "stem"), wav.join(lab, "stem", "left_anti")


def lyrics(spark: SparkSession, folder: str) -> DataFrame:
    return whole_texts(spark, folder, ".txt").select("stem", F.trim("text").alias("lyric"))


def labels_with_lyrics(labels: DataFrame, lyric: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels with the lyric of their source, sources without): the source is the stem up to its last underscore."""
    keyed = labels.withColumn("source", F.regexp_replace("stem", r"_[^_]*$", ""))
    lyric = lyric.withColumnRenamed("stem", "source")
    return keyed.join(lyric, "source", "left"), keyed.join(lyric, "source", "left_anti").select("source").distinct()


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """audio, phones of a manifest; blank lines are skipped."""
    return spark.read.schema("audio string, phones string").json(path).where("audio is not null")


def chunk_manifest(spark: SparkSession, path: str) -> DataFrame:
    """index, offset, duration, text and source of each chunk; the root may also be the bare list."""
    text = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("t"))
    root = F.from_json("t", F.lit(f"struct<{_colons(MANIFEST)}>"))
    bare = F.from_json("t", F.lit("array<struct<index:int,offset:double,duration:double,text:string>>"))
    d = text.select(F.when(F.startswith("t", F.lit("[")), bare).otherwise(root["chunks"]).alias("chunks"), root["source"]["path"].alias("source_path"), root["source"]["md5"].alias("source_md5"))
    return d.select("source_path", "source_md5", F.inline("chunks"))


def _colons(schema: str) -> str:
    return "source:struct<path:string,md5:string>,chunks:array<struct<index:int,offset:double,duration:double,text:string>>"


def slices(samples: Column, offset: Column, duration: Column, sr: int) -> Column:
    """Samples of a stored chunk: bounds rounded and clipped, empty where nothing is left."""
    a = F.greatest(F.lit(0), F.rint(offset * sr).cast("int"))
    b = F.least(F.size(samples), F.rint((offset + duration) * sr).cast("int"))
    return F.when(b > a, F.slice(samples, a + 1, b - a)).otherwise(F.slice(samples, 1, 0))


def key_values(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """key, value of ``key:value`` lines; with ``sep`` (a comma or a blank) the value is an array."""
    d = spark.read.text(path).where(F.col("value").contains(":"))
    key, val = F.trim(F.substring_index("value", ":", 1)), F.trim(F.expr("substring(value, locate(':', value) + 1)"))
    return d.select(key.alias("key"), (F.split(val, sep) if sep else val).alias("value"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, phones of tab-separated lines."""
    d = spark.read.schema("word string, ph string").option("sep", "\t").option("quote", "").csv(path)
    return d.select("word", F.filter(F.split(F.trim("ph"), " +"), lambda x: x != "").alias("phones"))


def phones_of(words: DataFrame, entries: DataFrame) -> DataFrame:
    """``words`` (utt, word_idx, word) to (utt, ph_idx, ph, word_idx): unknown words go, silence stands
    between words and at both ends, once."""
    from pyspark.sql import Window as W

    known = words.join(entries, "word").select("utt", "word_idx", F.posexplode("phones").alias("k", "ph"))
    n = F.max("word_idx").over(W.partitionBy("utt"))
    gaps = known.select("utt", "word_idx").distinct().withColumn("_n", n)
    after = gaps.select("utt", "word_idx", F.lit(10_000).alias("k"), F.lit("SP").alias("ph"))
    head = gaps.groupBy("utt").agg(F.min("word_idx").alias("word_idx")).select("utt", "word_idx", F.lit(-1).alias("k"), F.lit("SP").alias("ph"))
    rows = known.unionByName(after).unionByName(head)
    idx = F.row_number().over(W.partitionBy("utt").orderBy("word_idx", "k")) - 1
    return rows.select("utt", idx.cast("bigint").alias("ph_idx"), "ph", F.when(F.col("ph") == "SP", -1).otherwise(F.col("word_idx")).cast("bigint").alias("word_idx"))


def state(spark: SparkSession, path: str) -> DataFrame:
    """The table of finished sources; empty where there is none yet."""
    try:
        return spark.read.schema(STATE).parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STATE)


def todo(sources: DataFrame, done: DataFrame) -> DataFrame:
    """Sources whose content is not in the state table."""
    return sources.join(done.select("md5").distinct(), "md5", "left_anti")


def upserted(done: DataFrame, new: DataFrame) -> DataFrame:
    """The state table with ``new`` rows in place of older ones of the same content."""
    from pyspark.sql import Window as W

    both = done.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy("md5").orderBy(F.desc("_v")))).where("_r = 1").drop("_v", "_r")
