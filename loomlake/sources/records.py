"""Readers and writers of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import truncate

ARTICLE = "doc_id string, content_type string, source_site string, url string, title string, language string, published_date_raw string, tags array<string>, raw_html_path string, clean_text string, text_length int"
BOOK = "doc_id string, content_type string, source_site string, url string, title string, language string, pdf_url string, pdf_path string, text_source string, clean_text string, text_length int"
QA = "question string, answer string, title string, clean_text string"


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "tolerant") -> DataFrame:
    """mode: 'tolerant' and 'lenient' drop bad lines, 'strict' raises on one, 'keep' has them in _corrupt_record."""
    reader = spark.read.schema(schema)
    if mode == "strict":
        return reader.option("mode", "FAILFAST").json(path)
    if mode == "keep":
        return spark.read.schema(schema + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return reader.option("mode", "DROPMALFORMED").json(path)


def read_numbered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with line_num, from 1 in each file; bad lines keep their number and have nulls."""
    return _numbered_lines(spark, path).select("line_num", F.from_json("value", schema).alias("r")).select("line_num", "r.*")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """f, line_num, value of the lines that aren't blank. Lines are numbered in each block that a task reads, and the counts of a
    file's earlier blocks are added."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("o"))
    blocks = lines.groupBy("f", "s").agg(F.count("*").alias("n"))
    before = Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("f", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = lines.withColumn("i", F.row_number().over(Window.partitionBy("f", "s").orderBy("o"))).join(bases, ["f", "s"])
    return numbered.where("trim(value) <> ''").select("f", (F.col("base") + F.col("i")).alias("line_num"), "value")


def read_checked_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line_num, reason, r (the record) of every line that isn't blank. Lines are split as bytes and checked before
    they are decoded: one that is no UTF-8 has the reason 'bad UTF-8' and is read with U+FFFD in place of the broken bytes;
    one that is no JSON object has 'bad JSON' and no record. Lines are numbered as in ``read_numbered_jsonl``."""
    lines = _numbered_lines(spark, path).withColumn("ok", F.is_valid_utf8("value")).withColumn("value", F.make_valid_utf8("value"))
    record = F.from_json("value", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    read = lines.select(F.col("f").alias("file"), "line_num", "ok", record.alias("r"), F.col("value").rlike(r"^\s*\{").alias("object"))
    bad = ~F.col("object") | F.col("r").isNull() | F.col("r.__bad").isNotNull()
    reason = F.when(bad, "bad JSON").when(~F.col("ok"), "bad UTF-8")
    return read.select("file", "line_num", reason.alias("reason"), F.when(~bad, F.col("r").dropFields("__bad")).alias("r"))


def bad_lines(checked: DataFrame) -> DataFrame:
    """file, line_num, reason of the lines with a fault."""
    return checked.where("reason is not null").select("file", "line_num", "reason")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array of all rows, one text file; for small tables such as ratings and reports."""
    whole = df.agg(F.to_json(F.collect_list(F.struct("*")), {"ignoreNullFields": "false"}).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, multiLine=True, quote='"', escape='"')


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)


def qa_documents(pairs: DataFrame, prefix: str = "qa") -> DataFrame:
    """pairs (id, question, answer and maybe title, clean_text) as documents. Ids come from the key, not from a running
    number over the whole table."""
    title = F.col("title") if "title" in pairs.columns else F.lit(None).cast("string")
    text = F.col("clean_text") if "clean_text" in pairs.columns else F.lit(None).cast("string")
    return pairs.withColumns({"doc_id": F.concat(F.lit(prefix + "_"), F.col("id").cast("string")), "clean_text": F.coalesce(text, "answer"), "title": F.coalesce(F.nullif(title, F.lit("")), F.substring("question", 1, 200)), "kb_family": F.lit("qa_pair"), "content_type": F.lit("qa_pair")}).drop("id")


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """id, question, answer: user turns with the assistant turn that follows."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"__r": F.lead("role").over(after), "answer": F.lead("text").over(after)})
    return rows.where("role = 'user' and __r = 'assistant'").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("question"), "answer")


def spread(df: DataFrame) -> DataFrame:
    """Rows of files that can't be split go to all cores; a table that has as many partitions already stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def load_documents(*sources: tuple[str, DataFrame | None]) -> DataFrame:
    """Union of (kb_family, documents); missing sources are passed over, missing columns are null."""
    parts = [df.withColumn("kb_family", F.coalesce(F.col("kb_family"), F.lit(f)) if "kb_family" in df.columns else F.lit(f)) for f, df in sources if df is not None]
    if not parts:
        raise ValueError("no source is there")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """On any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The preferred file or the first fallback that exists."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(paths[0])


def read_articles(spark: SparkSession, folder: str, name: str = "articles_all.jsonl") -> DataFrame:
    return read_jsonl(spark, first_existing(spark, f"{folder}/{name}"), ARTICLE)


def read_books(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """The cleaned books, or the repaired ones where those are not there; a file that is asked for by name has no stand-in."""
    names = [name] if name else ["books_all_ragclean.jsonl", "books_all_fixed.jsonl"]
    return read_jsonl(spark, first_existing(spark, *[f"{folder}/{n}" for n in names]), BOOK)


def inspection(docs: DataFrame, n: int = 3, columns: tuple[str, ...] = ("doc_id", "title", "clean_text")) -> DataFrame:
    """kb_family, n_rows, samples: the first n rows of each family by id, long values cut."""
    kept = [truncate(F.col(c).cast("string")).alias(c) for c in columns if c in docs.columns]
    counts = docs.groupBy("kb_family").agg(F.count("*").alias("n_rows"))
    first = docs.select("kb_family", *kept).withColumn("__n", F.row_number().over(Window.partitionBy("kb_family").orderBy(columns[0]))).where(F.col("__n") <= n)
    samples = first.groupBy("kb_family").agg(F.array_sort(F.collect_list(F.struct("__n", *[c for c in columns if c in docs.columns]))).alias("s"))
    return counts.join(samples.select("kb_family", F.transform("s", lambda x: x.dropFields("__n")).alias("samples")), "kb_family", "left")


def write_report(report: DataFrame, path: str) -> None:
    """A small table as JSON lines, one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_text_report(report: DataFrame, path: str, title: str = "") -> None:
    """A small table as text, one file: the title, a line of column names, and a line for each row, in order, with its values
    between tabs; null is empty, and tabs and line ends inside a value are blanks."""
    spark = report.sparkSession
    values = [F.translate(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), "\t\r\n", "   ") for c in report.columns]
    body = report.orderBy(*[F.col(f"`{c}`") for c in report.columns]).select(F.concat_ws("\t", *values).alias("value"), (F.monotonically_increasing_id() + 2).alias("n"))
    head = spark.createDataFrame([(0, title), (1, "\t".join(report.columns))], "n long, value string").where("value <> '' or n > 0")
    body.unionByName(head).orderBy("n").select("value").coalesce(1).write.mode("overwrite").text(path)


def pending(candidates: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Distinct candidates that the checkpoint lacks, in order."""
    return candidates.select(key).distinct().join(done.select(key).distinct(), key, "left_anti").orderBy(key)
