"""FASTA and FASTQ in, FASTA, plain lines and TSV out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files, gzipped or not: rid, name, comment, seq.

    A record is what stands between two line starts with ``>``; lines of a sequence are put together, of the
    header the first token is the name and the rest the comment. rid orders records as they stand in a file, files by name.
    A splittable file is read by many tasks; rid is made of the file's and the record's place.
    """
    text = spark.read.option("lineSep", "\n>").text(path)
    rows = _parsed(text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")), "file", "block", "at")
    splits = rows.select("file", "block").distinct().withColumn("nth", F.row_number().over(Window.orderBy("file", "block")) - 1)  # a row a split
    rid = F.shiftleft(F.col("nth").cast("bigint"), 33) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(splits, ["file", "block"]).select(rid.alias("rid"), "name", "comment", "seq")


def stream_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files as they arrive in a folder: file, name, comment, seq. A stream has no order of files, hence no rid."""
    text = spark.readStream.option("lineSep", "\n>").text(path)
    return _parsed(text.select("value", F.col("_metadata.file_path").alias("file")), "file")


def _parsed(text: DataFrame, *keep: str) -> DataFrame:
    """name, comment and seq of texts that stand between two line starts with ``>``."""
    rows = text.withColumn("v", F.regexp_replace("value", "^>", "")).where("length(trim(v)) > 0")
    head = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    rest = F.regexp_extract(head, r"^\s*\S+\s+(.*?)\s*$", 1)
    seq = F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"[\r\n]", "")
    return rows.select(*keep, F.regexp_extract(head, r"^\s*(\S*)", 1).alias("name"), F.nullif(rest, F.lit("")).alias("comment"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of four-line FASTQ files: rid, name, comment, seq; qualities are dropped."""
    text = spark.read.option("lineSep", "\n@").text(path).select(F.regexp_replace("value", "^@", "").alias("v"), F.monotonically_increasing_id().alias("rid"))
    lines = F.split("v", r"\r?\n")
    rows = text.where(F.size(lines) >= 3).select("rid", lines[0].alias("head"), lines[1].alias("seq"))
    return rows.select("rid", F.regexp_extract("head", r"^\s*(\S*)", 1).alias("name"), F.nullif(F.regexp_extract("head", r"^\s*\S+\s+(.*?)\s*$", 1), F.lit("")).alias("comment"), "seq")


def read_masked_superstring(spark: SparkSession, path: str) -> DataFrame:
    """The one record of a masked superstring file; more than one is an error."""
    rows = read_fasta(spark, path)
    count = rows.limit(2).count()
    if count != 1:
        raise ValueError(f"{path}: {'no' if not count else 'more than one'} record")
    return rows


def header(dataset: str, k: int, algorithm: str, mask: str, both_strands: bool = True) -> str:
    """The header line of a computed masked superstring."""
    return f">maskedsuperstring dataset='{dataset}' k={k} alg={algorithm} mask={mask} mode={'bidirectional' if both_strands else 'unidirectional'}"


def reoptimised_header(algorithm: str) -> Column:
    """The header line of a superstring with a new mask, from columns name and comment."""
    return F.concat_ws(" ", F.concat(F.lit(">"), F.col("name")), F.lit(f"reoptimized={algorithm}"), F.col("comment"))


def write_fasta(records: DataFrame, path: str, head: Column | None = None) -> None:
    """Write records (name, comment, seq) as FASTA text, one line a sequence."""
    head = F.concat_ws(" ", F.concat(F.lit(">"), F.col("name")), F.col("comment")) if head is None else head
    records.select(F.concat_ws("\n", head, "seq").alias("value")).write.text(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """One text a line, as for separated masks and superstrings."""
    rows.select(F.col(column).alias("value")).write.text(path)


def write_tsv(rows: DataFrame, path: str, by: str = "method") -> None:
    """A report, sorted, with a header line, in one file."""
    rows.orderBy(by).coalesce(1).write.csv(path, sep="\t", header=True)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A list of datasets, ``name @ url`` a line, # for comments: name (blanks as _), url."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    parts = F.split("value", " @ ")
    return lines.select(F.translate(F.trim(parts[0]), " ", "_").alias("name"), F.trim(parts[1]).alias("url"))
