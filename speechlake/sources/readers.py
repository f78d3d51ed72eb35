"""Readers: piped manifests, sidecars, evaluation lists, logs, catalogs, nested documents, audio."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectorized import portable_key
from ..tables import written


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value. Large files are read in blocks by many tasks: a line's number is its place in its
    block and the lines of the file's blocks before it (counted once; there is one row a block)."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    rows = written(rows)
    blocks = rows.groupBy("file", "_at").agg(F.min("_id").alias("_lo"), F.count("*").alias("_n"))
    before = W.partitionBy("file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file").alias("_f"), F.col("_at").alias("_a"), "_lo", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = rows.join(blocks, (F.col("file") == F.col("_f")) & (F.col("_at") == F.col("_a"))).withColumn("line", (F.col("_id") - F.col("_lo") + F.col("_base") + 1).cast("int"))
    return out.select("file", "line", F.when(F.col("line") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")).alias("value"))


def jsonl_corpus(spark: SparkSession, path: str, schema: str, wav: str) -> DataFrame:
    """JSON lines; relative paths in ``wav`` get the folder of their own file. A bad line fails the read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_path").alias("_f"))
    folder = F.regexp_replace("_f", r"/[^/]*$", "/")
    return rows.withColumn(wav, F.when(F.startswith(wav, F.lit("/")), F.col(wav)).otherwise(F.concat(folder, wav))).drop("_f")


def with_sibling(spark: SparkSession, path: str, schema: str, own: str, sibling: str) -> DataFrame:
    """stem and the fields of each JSON file in path that has a file of the same stem with the other ending."""
    stem = lambda c, end: F.regexp_replace(c, re.escape(end) + "$", "")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", f"*{own}").json(path)
    rows = rows.select(stem("_metadata.file_name", own).alias("stem"), *rows.columns)
    there = spark.read.format("binaryFile").option("pathGlobFilter", f"*{sibling}").load(path).select(stem(F.substring_index("path", "/", -1), sibling).alias("stem"))
    return rows.join(there.distinct(), "stem", "left_semi")


def piped_manifest(spark: SparkSession, path: str, header: str = "audio_file|text") -> DataFrame:
    """audio_file, text, line, reason: bad_header, malformed (fewer than two cells), relative_path or null."""
    rows = numbered_lines(spark, path)
    cells = F.split("value", r"\|", 2)
    bad = rows.where((F.col("line") == 1) & (F.trim("value") != header)).select("file").withColumn("_bad", F.lit(True))
    data = rows.where("line > 1 and trim(value) <> ''").join(bad.distinct(), "file", "left")
    audio, text = F.trim(cells[0]), F.trim(F.get(cells, F.lit(1)))
    reason = F.when(F.col("_bad"), "bad_header").when((F.size(cells) < 2) | (audio == "") | (text == ""), "malformed").when(~audio.startswith("/"), "relative_path")
    return data.select(audio.alias("audio_file"), text.alias("text"), "line", reason.alias("reason"))


def three_columns(spark: SparkSession, path: str) -> DataFrame:
    """utt|text|norm_text -> wav, text, norm_text"""
    rows = spark.read.schema("utt string, text string, norm_text string").option("sep", "|").option("quote", "").csv(path)
    return rows.select(F.concat(F.lit("wavs/"), "utt", F.lit(".wav")).alias("wav"), "text", "norm_text")


def sidecars(spark: SparkSession, path: str, suffix: str, tabbed: bool = False) -> DataFrame:
    """stem, text: the whole file, or what follows the tab in its first line."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    text = F.element_at(F.split(F.split("value", "\n")[0], "\t"), 2) if tabbed else F.regexp_replace("value", r"^\s+|\s+$", "")
    return files.select(F.substring_index(name, suffix, 1).alias("stem"), text.alias("text"))


def piped_eval_list(spark: SparkSession, path: str, base: str) -> DataFrame:
    """utt, prompt_text, prompt_wav, gt_text, gt_wav of lines with 4 or 5 fields."""
    c = F.split("value", r"\|")
    fixed = lambda x: F.when(x.startswith("/"), x).otherwise(F.concat(F.lit(base + "/"), x))
    gt = F.when(F.size(c) == 5, c[4]).otherwise(F.concat(F.lit("wavs/"), c[0], F.lit(".wav")))
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(c[0].alias("utt"), c[1].alias("prompt_text"), fixed(c[2]).alias("prompt_wav"), c[3].alias("gt_text"), fixed(gt).alias("gt_wav"))


def tabbed_eval_list(spark: SparkSession, path: str, base: str) -> DataFrame:
    """ref_utt, ref_dur, ref_txt, gen_utt, gen_dur, gen_txt; ids speaker-chapter-... give folders."""
    kinds = "ref_utt string, ref_dur double, ref_txt string, gen_utt string, gen_dur double, gen_txt string"
    wav = lambda u: F.concat(F.lit(base + "/"), F.split(u, "-")[0], F.lit("/"), F.split(u, "-")[1], F.lit("/"), F.col(u), F.lit(".flac"))
    rows = spark.read.schema(kinds).option("sep", "\t").option("quote", "").csv(path)
    return rows.withColumn("ref_wav", wav("ref_utt")).withColumn("gen_wav", wav("gen_utt"))


def json_log(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Append-only JSON lines; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checked_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line, the columns, reason: an append-only JSON log with its bad lines as rows. reason is malformed where a line is
    no JSON object of these types; empty lines are left out. Lines are numbered from 1, by many tasks for a large file."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    read = F.from_json("value", f"{schema}, _sl_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_sl_bad"})
    rows = lines.select("file", "line", F.explode(F.array(read)).alias("_sl_r"))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return rows.select("file", "line", *[f"_sl_r.{c}" for c in names], F.when(F.col("_sl_r").isNull() | F.col("_sl_r._sl_bad").isNotNull(), "malformed").alias("reason"))


def checked(log: DataFrame) -> DataFrame:
    """The columns of a log as from ``checked_log``; if it has a bad line, an error that names the first one."""
    bad = log.where("reason is not null").orderBy("file", "line").select("file", "line", "reason").first()
    if bad:
        raise ValueError(f"{bad['file']}, line {bad['line']}: {bad['reason']}")
    return log.drop("file", "line", "reason")


def catalog(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of the Markdown tables of a file, with the heading above; reason malformed where cells are missing,
    duplicate_key where the first column has come before in a line above or another file, compared as file systems do
    that fold compatibility forms (NFKC) and case."""
    lines = numbered_lines(spark, path)
    heading = F.when(F.col("value").rlike(r"^#+ "), F.regexp_extract("value", r"^#+ (.*)$", 1))
    w = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.last(heading, ignorenulls=True).over(w)).where(F.col("value").rlike(r"^\|") & ~F.col("value").rlike(r"^\|[\s:|-]+\|?$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    out = rows.select("file", "section", "line", cells.alias("_c")).where(F.get("_c", F.lit(0)) != columns[0])
    named = out.select("file", "section", "line", *[F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(columns)], (F.size("_c") != len(columns)).alias("_bad"))
    named = named.withColumn("_k1", portable_key(F.trim(columns[0])))
    key = F.col("_k1")
    first = named.where("not _bad").groupBy(key.alias("_k")).agg(F.min(F.struct("file", "line")).alias("_first"))
    again = named.join(first, key == F.col("_k"), "left").withColumn("reason", F.when(F.col("_bad"), "malformed").when(F.struct("file", "line") != F.col("_first"), "duplicate_key"))
    return again.select("section", "line", *columns, "reason")


def api_files(json: Column) -> list[Column]:
    """path, size, blob_id, sha256 of an API file entry with alternative spellings; nested lfs sizes win."""
    get = lambda *names: F.coalesce(*[F.get_json_object(json, f"$.{n}") for n in names])
    return [get("path", "rfilename").alias("path"), get("lfs.size", "size").cast("long").alias("size"), get("blob_id", "blobId", "oid").alias("blob_id"), get("lfs.sha256", "lfs.oid").alias("sha256")]


def file_faults() -> Column:
    """Of columns as from ``api_files``: digest (not 64 hex digits), blob (not 40), size (negative)."""
    bad = lambda c, n: F.coalesce(~F.col(c).rlike(f"^[0-9a-f]{{{n}}}$"), F.lit(True))
    return F.array_compact(F.array(F.when(bad("sha256", 64), F.lit("digest")), F.when(bad("blob_id", 40), F.lit("blob")), F.when(F.coalesce(F.col("size") < 0, F.lit(True)), F.lit("size"))))


def nested_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, duration, sample_rate, channels, frames, ok of PCM WAV files."""
    from ..operators.audio import read_wav

    def run(batches):
        for pdf in batches:
            rows = []
            for p, d, c in pdf[["path", "sha256", "content"]].itertuples(index=False):
                x = read_wav(c)
                rows.append((p, d, None, None, None, None, False) if x is None else (p, d, x[0].shape[1] / x[1], x[1], x[0].shape[0], x[0].shape[1], True))
            yield pd.DataFrame(rows, columns=["path", "sha256", "duration", "sample_rate", "channels", "frames", "ok"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInPandas(run, "path string, sha256 string, duration double, sample_rate int, channels int, frames long, ok boolean")
