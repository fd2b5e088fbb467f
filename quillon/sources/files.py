"""Readers and writers of documents, tables, listings, panels and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blanks around values are kept both ways.
#: How a null is written, so that it comes back as one and an empty text as an empty text.
NULL = "\\N"
CSV = {"header": True, "nullValue": NULL, "emptyValue": "", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False, strict: bool = True) -> DataFrame:
    """JSON documents (or lines) of a file or folder, compressed or not, with the file each came from.

    ``strict`` raises on a broken document; else its fields are null and ``_broken`` holds its text.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    reader = spark.read.option("multiLine", not lines)
    if strict:
        df = reader.schema(fields).option("mode", "FAILFAST").json(path)
    else:
        df = reader.schema(T.StructType([*fields.fields, T.StructField("_broken", T.StringType())])).option("columnNameOfCorruptRecord", "_broken").json(path)
    return df.withColumn("_file", F.col("_metadata.file_name"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; a path that is not there is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**CSV).option("multiLine", True).csv(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """path, name, size, modified of all files below ``path`` that match; with ``content`` also their SHA-256.

    Without ``content`` the files are not opened.
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    cols: list[Column] = [F.col("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return df.select(*cols, *([F.sha2("content", 256).alias("sha256")] if content else []))


def latest_file(files: DataFrame, prefix: str) -> DataFrame:
    """path of the last modified file whose name begins with ``prefix`` (ties: the later name)."""
    return files.where(F.startswith("name", F.lit(prefix))).agg(F.max_by("path", F.struct("modified", "name")).alias("path"))


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, state (ok, missing, wrong_size, wrong_hash) of each entry of manifest(name, size, sha256)."""
    j = manifest.join(files.select("name", F.col("size").alias("_size"), F.col("sha256").alias("_sha")), "name", "left")
    state = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("size"), "wrong_size").when(F.col("_sha") != F.col("sha256"), "wrong_hash").otherwise("ok")
    return j.select("name", state.alias("state"))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """name, place: the entries of a text file, one a line, without comments after ``#`` and empty lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("place", "line"))
    return lines.select(F.trim(F.split("line", "#")[0]).alias("name"), "place").where("name <> ''")


def read_shell_array(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """name, place: the quoted entries of ``variable=( "a" "b" )`` in a script."""
    body = F.regexp_extract("value", rf"(?s)\b{variable}=\((.*?)\)", 1)
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.regexp_extract_all(body, F.lit(r'"([^"]+)"'), F.lit(1))).alias("place", "name"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """file, seconds (from the last Started to the last Finished), models: name to seconds of ``<<< OK: name (Ns)`` lines.

    Names may have blanks; of a name's lines the last holds.
    """
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    last = lambda w: F.get(F.reverse(F.regexp_extract_all("value", F.lit(rf"(?m)^{w}:\s*(\S+ \S+|\S+)"), F.lit(1))), 0)
    stamp = lambda w: F.try_to_timestamp(F.nullif(last(w), F.lit("")))
    seconds = (F.unix_micros(stamp("Finished")) - F.unix_micros(stamp("Started"))) / 1e6
    ok = r"(?m)^[ \t]*<<< OK: (.+) \((\d+)s\)[ \t\r]*$"
    names, took = (F.reverse(F.regexp_extract_all("value", F.lit(ok), F.lit(i))) for i in (1, 2))
    t = t.select("file", seconds.alias("seconds"), names.alias("_names"), took.alias("_took"))
    each = F.array_distinct("_names")
    return t.select("file", "seconds", F.map_from_arrays(each, F.transform(each, lambda n: F.element_at("_took", F.array_position("_names", n).cast("int")).cast("int"))).alias("models"))


def write_one_csv(df: DataFrame, path: str, fields: list[str] | None = None, keep: bool = False) -> bool:
    """``df`` as one CSV with a header; an empty one is not written. ``keep`` refuses to replace.

    For ledgers and reports of bounded size; large tables go out with ``df.write``. The file commit makes
    it appear whole or not at all.
    """
    if df.isEmpty():
        return False
    out = df.select(*fields) if fields else df
    out.coalesce(1).write.mode("errorifexists" if keep else "overwrite").options(**CSV).csv(path)
    return True


def write_json(df: DataFrame, path: str, compressed: bool = False) -> None:
    """``df`` as JSON lines, committed as a whole."""
    df.write.mode("overwrite").option("compression", "gzip" if compressed else "none").option("ignoreNullFields", False).json(path)


def markdown(title: str, df: DataFrame, limit: int = 200) -> str:
    """A report table of a small result; ``limit`` rows are shown and the rest counted."""
    rows = df.limit(limit + 1).collect()
    text = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(text(v) for v in r) + " |" for r in rows[:limit]]]
    return "\n".join(lines + (["", f"More than {limit} rows."] if len(rows) > limit else [])) + "\n"
