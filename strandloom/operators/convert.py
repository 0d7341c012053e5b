"""Conversions between masked superstrings, separated ones and sets of strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame) -> DataFrame:
    """Distinct masked superstrings (ms_id, k, superstring, mask) that are whole: letters of ACGT in either case and a mask of 0 and 1 of the same length. Superstrings in upper case."""
    good = rows.where("ms_id is not null and k > 0 and length(superstring) > 0 and length(superstring) = length(mask) and translate(mask, '01', '') = '' and translate(superstring, 'ACGTacgt', '') = ''")
    return good.select("ms_id", "k", F.upper("superstring").alias("superstring"), "mask").distinct()


def faults(rows: DataFrame) -> DataFrame:
    """What is wrong with each masked superstring: ms_id, fault (null for none)."""
    return rows.select("ms_id", F.expr("""case when superstring is null then 'no superstring' when mask is null then 'no mask' when translate(superstring, 'ACGTacgt', '') <> '' then 'letters'
        when translate(mask, '01', '') <> '' then 'digits' when length(mask) <> length(superstring) then 'length' end""").alias("fault"))


def split_case(rows: DataFrame, column: str = "seq") -> DataFrame:
    """Mask and superstring of a text whose upper case letters are ones."""
    return rows.withColumn("mask", F.regexp_replace(F.regexp_replace(column, "[A-Z]", "1"), "[^1]", "0")).withColumn("superstring", F.upper(column))


def _bits(mask: str) -> np.ndarray:
    return np.frombuffer(mask.encode("ascii", "replace"), np.uint8) == ord("1")


def _runs(mask: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the runs of ones."""
    step = np.diff(np.concatenate(([False], _bits(mask), [False])).astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def join_case(rows: DataFrame) -> DataFrame:
    """``seq``: superstring and mask as one text, ones in upper case; null for null. Letters past the end of the mask are in lower case."""

    @F.pandas_udf("string")
    def joined(text: pd.Series, mask: pd.Series) -> pd.Series:
        out = []
        for s, m in zip(text, mask):
            if s is None or m is None:
                out.append(None)
                continue
            raw = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
            one = np.zeros(len(raw), bool)
            one[: len(m)] = _bits(m)[: len(raw)]
            letter = (raw | 32 >= ord("a")) & (raw | 32 <= ord("z"))
            out.append(np.where(letter, np.where(one, raw & 223, raw | 32), raw).astype(np.uint8).tobytes().decode("ascii"))
        return pd.Series(out, dtype=object)

    return rows.withColumn("seq", joined("superstring", "mask"))


def ones(rows: DataFrame, *keys: str) -> DataFrame:
    """Runs of ones of ``mask``: keys, first, last (positions from 0). Null masks give none."""
    keys = keys or ("ms_id",)
    kinds = dict(rows.dtypes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, mask in enumerate(batch.column("mask").to_pylist()):
                first, last = _runs(mask)
                own = pa.array(np.full(len(first), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in keys), pa.array(first), pa.array(last)], names=[*keys, "first", "last"])

    return rows.where("mask is not null").select(*keys, "mask").mapInArrow(find, ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["first bigint", "last bigint"]))


def flips(rows: DataFrame) -> DataFrame:
    """Positions at which a mask changes (before the first position it is 1): ms_id, pos."""
    kind = dict(rows.dtypes)["ms_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, mask in enumerate(batch.column("mask").to_pylist()):
                at = np.flatnonzero(np.diff(np.concatenate(([True], _bits(mask))).astype(np.int8)))
                yield pa.RecordBatch.from_arrays([batch.column("ms_id").take(pa.array(np.full(len(at), i))), pa.array(at)], names=["ms_id", "pos"])

    return rows.where("mask is not null").select("ms_id", "mask").mapInArrow(find, f"ms_id {kind}, pos bigint")


def to_strings(rows: DataFrame) -> DataFrame:
    """The strings of a masked superstring: ms_id, sid (from 0), seq. A run of ones with the k - 1 letters after it, as far as there are any."""
    kind = dict(rows.dtypes)["ms_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (k, text, mask) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "superstring", "mask")))):
                first, last = _runs(mask)
                text = text.upper()
                own = pa.array(np.full(len(first), i))
                yield pa.RecordBatch.from_arrays([batch.column("ms_id").take(own), pa.array(np.arange(len(first))), pa.array([text[a : b + k] for a, b in zip(first.tolist(), last.tolist())], pa.string())], names=["ms_id", "sid", "seq"])

    return rows.where("k is not null and superstring is not null and mask is not null").select("ms_id", "k", "superstring", "mask").mapInArrow(cut, f"ms_id {kind}, sid bigint, seq string")


def from_strings(records: DataFrame, k: int) -> DataFrame:
    """Each record of at least k letters as a part of a masked superstring: its columns with ``part``, the last k - 1 letters in lower case."""
    seq = F.upper("seq")
    return records.where(F.length("seq") >= k).withColumn("part", F.concat(F.left(seq, F.length(seq) - (k - 1)), F.lower(F.right(seq, F.lit(k - 1))) if k > 1 else F.lit("")))


def concatenated(parts: DataFrame, key: str, order: str, column: str = "part") -> DataFrame:
    """The parts of each key in order, as one text: key, seq. For a sink; the parts themselves are the distributed form."""
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, column))).alias("_parts")).select(key, F.expr(f"array_join(transform(_parts, y -> y.{column}), '')").alias("seq"))


def swap_alphabet(rows: DataFrame, column: str = "mask", back: bool = False) -> DataFrame:
    """A mask written with A and C in place of 0 and 1, or back."""
    return rows.withColumn(column, F.translate(column, "AC", "01") if back else F.translate(column, "01", "AC"))
