"""Measures of superstrings and masks: lengths, runs, encodings, sizes, equality of sets."""

from __future__ import annotations

import bz2
import lzma

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .convert import flips  # noqa: F401
from .kmers import kmer_set


def _bits(x: Column) -> Column:
    """Binary digits of a positive whole number."""
    return F.length(F.conv(x, 10, 2))


def elias_fano_bits(length: Column, boundaries: Column) -> Column:
    """Size in bits of a mask of ``length`` positions with so many boundaries (0 and each change), in strict Elias-Fano form, in whole 64-bit words."""
    u, n = length - boundaries + 1, boundaries
    low = F.when(u > n, _bits(F.floor(u / n)) - 1).otherwise(0)
    high = n + F.floor(u / F.pow(F.lit(2), low)) + 2
    pointer = F.when(high > 1, _bits((high - 1).cast("bigint"))).otherwise(0)
    bits = F.floor((high - n) / 512) * pointer + F.floor(n / 256) * pointer + high + n * low
    return (F.ceil(bits / 64) * 64).cast("bigint")


def mask_sizes(ms: DataFrame) -> DataFrame:
    """Of each masked superstring: ms_id, length, ones, runs (of ones), elias_fano (bits)."""
    changes = F.length(F.regexp_replace(F.regexp_replace("mask", "01", "0x1"), "10", "1x0")) - F.length("mask")
    rows = ms.select("ms_id", F.length("superstring").cast("bigint").alias("length"), F.length(F.translate("mask", "0", "")).cast("bigint").alias("ones"), changes.cast("bigint").alias("changes"), (F.left("mask", F.lit(1)) == "1").cast("bigint").alias("head"))
    runs = F.floor((F.col("changes") + F.col("head") + 1) / 2).cast("bigint")
    return rows.select("ms_id", "length", "ones", runs.alias("runs"), elias_fano_bits(F.col("length"), F.col("changes") + 1).alias("elias_fano"))


def run_lengths(ones: DataFrame, *keys: str) -> DataFrame:
    """How often each length of a run of ones occurs: keys, run_length, n."""
    keys = keys or ("ms_id",)
    return ones.select(*keys, (F.col("last") - F.col("first") + 1).alias("run_length")).groupBy(*keys, "run_length").agg(F.count("*").alias("n"))


def report_sizes(results: DataFrame) -> DataFrame:
    """Published lengths and runs (dataset, k, method, superstring, mask; each one too large by a newline) with the size of the mask: adds elias_fano.

    -1 and null are not applicable; repeated rows count once.
    """
    good = results.distinct().where("superstring > 1 and mask > 1")
    return good.withColumn("elias_fano", elias_fano_bits(F.col("superstring") - 1, 2 * (F.col("mask") - 1)))


def report_grid(results: DataFrame) -> DataFrame:
    """Lengths by dataset and k, a column for each method that there is (a repeated row counts once, -1 as null)."""
    rows = results.where("dataset is not null and method is not null").withColumn("superstring", F.when(F.col("superstring") >= 0, F.col("superstring")))
    return rows.groupBy("dataset", "k").pivot("method").agg(F.max("superstring"))


def bits_per_letter(results: DataFrame) -> DataFrame:
    """Reported lengths with the bits of their letters (two each) and of their masks, together for each k-mer of the set (``kmer_count``, a true value): dataset, k, method, bits, per_kmer.

    Rows that aren't applicable, and sets without a reported number of k-mers, are left out; repeated rows count once.
    """
    kmers_ = results.where("method = 'kmer_count' and mask > 0").select("dataset", "k", F.col("mask").alias("kmers")).distinct()
    each = report_sizes(results).where("method <> 'kmer_count' and method not like 'lowerbound%'")
    bits = 2 * (F.col("superstring") - 1) + F.col("elias_fano")
    return each.join(kmers_, ["dataset", "k"]).select("dataset", "k", "method", bits.alias("bits"), (bits / F.col("kmers")).alias("per_kmer")).distinct()


def set_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two k-mer sets (c) are equal: count_a, count_b, count_union, equal. One shuffle of both; a k-mer may stand in a side several times."""
    sides = a.select("c", F.lit(1).alias("s")).union(b.select("c", F.lit(2).alias("s")))
    each = sides.groupBy("c").agg(F.bit_or("s").alias("s"))
    total = each.agg(F.count_if(F.col("s") != 2).alias("count_a"), F.count_if(F.col("s") != 1).alias("count_b"), F.count("*").alias("count_union"))
    return total.withColumn("equal", (F.col("count_a") == F.col("count_union")) & (F.col("count_b") == F.col("count_union")))


def minimality(windows_: DataFrame, *keys: str) -> DataFrame:
    """Windows and distinct k-mers: keys, total, distinct_kmers; equal for a set in which nothing repeats. Two steps, so that no group holds all k-mers."""
    return windows_.groupBy(*keys, "c").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("distinct_kmers"))


def equal_after(records: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """``set_equality`` of the k-mers of two tables of records."""
    return set_equality(kmer_set(records, k), kmer_set(result, k))


def compressed_sizes(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Bytes of each text as it is, by xz and by bzip2: key, raw, xz, bz2."""

    @F.pandas_udf("raw bigint, xz bigint, bz2 bigint")
    def sizes(texts: pd.Series) -> pd.DataFrame:
        data = [t.encode() for t in texts]
        return pd.DataFrame({"raw": map(len, data), "xz": (len(lzma.compress(d, preset=9)) for d in data), "bz2": (len(bz2.compress(d)) for d in data)})

    return rows.where(F.col(column).isNotNull()).select(key, sizes(column).alias("s")).select(key, "s.*")
