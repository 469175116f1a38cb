"""Sources: JSON lines in several strictnesses, plain texts, file inventories, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORPUS = "text string, doc_id string, para_id string, source_type string, source_file string, is_priority boolean"


def lenient(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """Rows of the lines that parse and have a text; absent ids are 'unknown'."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl").json(path).where("text IS NOT NULL")
    return rows.fillna("unknown", [c for c in ("doc_id", "para_id") if c in rows.columns])


def numbered(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """As `lenient`, but absent ids are the file's stem and the line's number in the file, blank lines counted."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1).alias("stem"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    rows = lines.where(F.trim("line") != "").withColumn("r", F.from_json("line", schema)).where("r.text IS NOT NULL")
    return rows.select("r.text", F.coalesce("r.doc_id", "stem").alias("doc_id"), F.coalesce("r.para_id", F.concat(F.lit("p"), F.col("i") + 1)).alias("para_id"))


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all lines; one that doesn't parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def reported(spark: SparkSession, path: str, schema: str, pattern: str = "feedback_*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines with their file) of the files of that name."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", pattern).json(path)
    named = rows.select("*", F.col("_metadata.file_name").alias("file"))
    return named.where("_bad IS NULL").drop("_bad"), named.where("_bad IS NOT NULL").select("file", F.col("_bad").alias("line"))


def config(spark: SparkSession, path: str, schema: str, default: dict) -> DataFrame:
    """The one row of a JSON file, or the default where there is none."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.createDataFrame([default], schema)


def plain(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, is_priority) of whole text files."""
    rows = spark.read.option("pathGlobFilter", "*.{txt,TXT}").option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("is_priority", F.col("path").contains("/important_examples/"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, extension, is_priority, valid) of the documents of a corpus folder; valid by size and magic bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    magic = F.when(ext == "pdf", F.substring("content", 1, 4) == F.lit(b"%PDF")).when(ext == "docx", F.substring("content", 1, 2) == F.lit(b"PK")).otherwise(F.lit(True))
    return rows.where(ext.isin("pdf", "docx", "txt", "md", "tex")).select("path", "length", ext.alias("extension"), F.col("path").contains("/important_examples/").alias("is_priority"), ((F.col("length") >= 1024) & magic).alias("valid"))


def inventory(files: DataFrame) -> DataFrame:
    """(extension, files, bytes, priority, invalid) of a listing."""
    return files.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.count_if("is_priority").alias("priority"), F.count_if(~F.col("valid")).alias("invalid"))


def runs(spark: SparkSession, path: str, schema: str, limit: int = 10) -> DataFrame:
    """The latest run folders with a metadata file, by name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{path}/*/metadata.json").withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/metadata\.json$", 1))
    return rows.orderBy(F.desc("folder")).limit(limit)


def models(spark: SparkSession, path: str, prefix: str = "model-") -> DataFrame:
    """(model, files): folders of that prefix that hold both configurations and adapter weights."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("model"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    has = lambda *names: F.max(F.col("file").isin(*names).cast("int")) == 1
    found = rows.where(F.col("model").startswith(prefix)).groupBy("model").agg(F.count(F.lit(1)).alias("files"), has("training_config.json").alias("a"), has("adapter_config.json").alias("b"), has("adapter_model.safetensors", "adapter_model.bin").alias("c"))
    return found.where("a AND b AND c").select("model", "files")


def log_history(spark: SparkSession, path: str) -> DataFrame:
    """(step, loss, eval_loss, kind) of a trainer's state file."""
    rows = spark.read.schema("log_history array<struct<step:bigint,loss:double,eval_loss:double>>").option("multiLine", True).json(path).select(F.explode("log_history").alias("h")).select("h.*")
    return rows.withColumn("kind", F.when(F.col("eval_loss").isNotNull(), "eval").when(F.col("loss").isNotNull(), "train")).where("kind IS NOT NULL")


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines that aren't blank, in order."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    return rows.orderBy("at").limit(n).select(F.row_number().over(Window.orderBy("at")).alias("line"), "value")
