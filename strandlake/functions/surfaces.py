"""Functions for SQL: an aggregate of a sketch and a table function of minimizers.

    register(spark)
    spark.sql("SELECT src, sketch_f0(hash) FROM hashes GROUP BY src")
    spark.sql("SELECT s.id, m.* FROM s, LATERAL minimizers(s.sequence, 12, 10) m")

The aggregate takes a group's hashes at once and so suits groups of bounded size; over
groups of any size use operators.sketch.bitmaps and f0_by_group, whose state is partial
and merges. The same in SQL, for s = 2 and r = 22:

    SELECT src, -ln(1 - sum(bitmap_count(bits)) / 4194304D) * 16777216D AS f0
    FROM (SELECT src, bitmap_bucket_number(hash & 4194303) AS bucket,
                 bitmap_construct_agg(bitmap_bit_position(hash & 4194303)) AS bits
          FROM hashes WHERE shiftrightunsigned(hash, 62) = 0 GROUP BY src, bucket)
    GROUP BY src"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlake.functions import alphabet as A
from strandlake.operators.minimizers import _windowed
from strandlake.operators.qgrams import Windows


def f0_of_hashes(hashes: np.ndarray, s: int = 2, r: int = 22) -> float:
    """The number of distinct 64-bit hashes, from the share of empty slots; nan if no
    slot is empty."""
    h = hashes.astype(np.int64).view(np.uint64)
    used = len(np.unique(h[h >> np.uint64(64 - s) == 0] & np.uint64((1 << r) - 1)))
    return float("nan") if used >= 1 << r else float(-np.log((float(1 << r) - used) / float(1 << r)) * float(1 << (s + r)))


def sketch_f0(hashes: pd.Series) -> float:
    return f0_of_hashes(hashes.dropna().to_numpy(np.int64))


class Minimizers:
    """The minimizers of one sequence by integer codes; none for null."""

    def eval(self, sequence: str, q: int, window: int) -> Iterator[tuple[int, int]]:
        if sequence:
            w = Windows([0], [sequence], q, A.DNA)
            values = w.values("code")
            best = _windowed(w, values, window)
            yield from zip(values[best].tolist(), w.at[best].tolist())


def register(spark: SparkSession) -> None:
    spark.udf.register("sketch_f0", F.pandas_udf(sketch_f0, "double"))
    spark.udtf.register("minimizers", F.udtf(Minimizers, returnType="hash: long, pos: long"))
