"""Superstrings without a graph: streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kmers import first_positions, first_windows


def streaming(records: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """The streaming superstring in parts, one for each record that adds k-mers: rid, part.

    In the order of (rid, pos) a position has a one if its k-mer wasn't there before; what the windows of the ones cover
    is written, ones in upper case. The parts in the order of rid are the superstring. Only k-mers and positions are shuffled; the letters are taken from the records.
    """
    first = first_positions(records, k, both_strands) if k <= 31 else first_windows(records, k, both_strands)
    ones = first.groupBy("rid").agg(F.sort_array(F.collect_list(F.col("pos").cast("int"))).alias("ones"))  # not more than the record has letters

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text, at in zip(batch.column("seq").to_pylist(), batch.column("ones")):
                at = at.values.to_numpy()
                shown = np.minimum(np.diff(np.append(at, at[-1] + k)), k)
                begin = np.cumsum(shown) - shown
                letters = np.frombuffer(text.encode("ascii", "replace"), np.uint8)[np.repeat(at - begin, shown) + np.arange(shown.sum())]
                low = np.ones(len(letters), bool)
                low[begin] = False
                parts.append(np.where(low, letters | 32, letters & 223).astype(np.uint8).tobytes().decode("ascii"))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(parts, pa.string())], names=["rid", "part"])

    kind = dict(records.dtypes)["rid"]
    return records.select("rid", "seq").join(ones, "rid").select("rid", "seq", "ones").mapInArrow(write, f"rid {kind}, part string")
