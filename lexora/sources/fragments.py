"""Sources: DataFrames of fragments."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.operators import phpscan, suppression
from lexora.schema import DEFAULT_KINDS, FRAGMENT, OFFSETS


def fragment(key: Column, text: Column, language: Column, source: str, attributes: Column, location: Column | None = None, mode: str = "prose") -> list[Column]:
    """The columns of a fragment; the key makes its id, so that ids don't depend on partitions."""
    none = F.lit(None).cast("struct<path:string,line:int,column:int,logical:string>")
    return [key.cast("string").alias("fragment_id"), text.alias("text"), text.alias("original_text"), language.alias("language"), F.struct(F.lit(source).alias("source"), attributes.cast("map<string,string>").alias("attributes")).alias("context"), (location if location is not None else none).alias("location"), F.lit(None).cast(OFFSETS).alias("offsets"), F.lit(mode).alias("mode")]


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """In-memory fragments; an empty original text is the text."""
    df = spark.createDataFrame(rows, FRAGMENT)
    return df.withColumn("original_text", F.when(F.coalesce("original_text", F.lit("")) == "", F.col("text")).otherwise(F.col("original_text")))


def chain(*sources: DataFrame) -> DataFrame:
    """All fragments; source_index keeps the order of the sources."""
    out = None
    for k, df in enumerate(sources):
        df = df.withColumn("source_index", F.lit(k))
        out = df if out is None else out.unionByName(df)
    return out


def size_in_bytes(text: str) -> int:
    unit = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30}.get(text[-1:].upper(), 1)
    return int(text[:-1] if unit > 1 else text) * unit


@dataclass(frozen=True)
class PhpSource:
    """Names of PHP files under paths; files given by name skip the tests of name, size and exclusion."""

    paths: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    kinds: tuple[str, ...] = DEFAULT_KINDS
    language: str = "en"
    max_size: str = "2M"
    prefix: str = suppression.PREFIX
    project_dir: str = ""
    name: str = "php"

    def with_paths(self, *paths: str) -> "PhpSource":
        return replace(self, paths=paths)

    def kind_of(self, spark: SparkSession, path: str) -> str:
        """"file", "folder" or "none", by the file system that the path names."""
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        return "none" if not files.exists(where) else "folder" if files.getFileStatus(where).isDirectory() else "file"

    def missing(self, spark: SparkSession) -> list[str]:
        return [p for p in self.paths if self.kind_of(spark, p) == "none"]

    def files(self, spark: SparkSession) -> DataFrame:
        """path, content. Excluded are files of a folder whose path in it holds a text, or matches a pattern between two signs like #^tests/#."""
        out = None
        for p in self.paths:
            kind = self.kind_of(spark, p)
            if kind == "none":
                continue
            read = spark.read.format("binaryFile")
            df = read.load(p) if kind == "file" else read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.php").load(p).where(F.col("length") < size_in_bytes(self.max_size))
            df = df.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
            if kind == "folder":
                inside = F.substring_index("path", p.rstrip("/").removeprefix("file://") + "/", -1)
                for x in self.exclude:
                    delimited = len(x) > 2 and x[0] == x[-1] and not x[0].isalnum() and x[0] not in "\\ "
                    df = df.where(~(inside.rlike(x[1:-1]) if delimited else F.contains(inside, F.lit(x))))
            out = df if out is None else out.unionByName(df)
        return out if out is not None else spark.createDataFrame([], "path string, content binary")

    def scanned(self, spark: SparkSession) -> DataFrame:
        return phpscan.scan(self.files(spark), self.kinds, self.prefix)

    def fragments(self, spark: SparkSession) -> DataFrame:
        return phpscan.fragments(self.scanned(spark), self.language, self.project_dir)

    def suppressed(self, spark: SparkSession) -> int:
        """Names on ignored lines."""
        return self.scanned(spark).agg(F.coalesce(F.sum("suppressed"), F.lit(0))).first()[0]

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        bad = self.scanned(spark).where("error is not null").select(F.substring_index("error", ":", 1).alias("code"), "error", "path")
        gone = spark.createDataFrame([("skipped_file", "no such file", p) for p in self.missing(spark)] or [], "code string, error string, path string")
        place = F.struct(F.col("path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("logical"))
        return bad.unionByName(gone).select("code", F.col("error").alias("message"), place.alias("location"))
