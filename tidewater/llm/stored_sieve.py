"""A sieve of hashes that tasks write to the shared folder and workers map, so that nothing of it passes the driver."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir
from .ngram_lm import Arrays
from .ngram_lm import _write as write_arrays

#: Bits of one file, which one task fills.
FILE_BITS = 1 << 23


class StoredSieve:
    """A bit for each hash modulo `bits`, in files of FILE_BITS; a file that isn't there has no bits."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.arrays: Arrays | None = None  # opened in the worker

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may be among those stored; all of these are."""
        self.arrays = self.arrays or Arrays(self.folder, 0)
        b = h.view(np.uint64) & np.uint64(self.bits - 1)
        file, own = b // np.uint64(FILE_BITS), b % np.uint64(FILE_BITS)
        out = np.zeros(len(h), bool)
        for k in np.unique(file).tolist():
            words = self.arrays.array(0, k, "hash")
            if len(words):
                at = np.flatnonzero(file == k)
                out[at] = (words[(own[at] >> np.uint64(6)).astype(np.int64)] >> (own[at] & np.uint64(63))) & np.uint64(1) != 0
        return out


def stored_sieve(hashes: DataFrame, bits: int) -> StoredSieve:
    """The sieve of a column of hashes; bits is a power of two, 64 at least. What it lets through wrongly is compared and
    found unique, so its size bears on speed alone. The driver gets the numbers of the files."""
    spark = hashes.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    files, words = max(1, bits // FILE_BITS), min(bits, FILE_BITS) // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled: dict[int, np.ndarray] = {}
        for batch in batches:
            b = batch.column(0).to_numpy().view(np.uint64)
            for k in np.unique(b // np.uint64(FILE_BITS)).tolist():
                own = b[b // np.uint64(FILE_BITS) == k] % np.uint64(FILE_BITS)
                np.bitwise_or.at(filled.setdefault(k, np.zeros(words, np.uint64)), (own >> np.uint64(6)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
        for k, array in filled.items():
            write_arrays(folder, 0, k, {"hash": array})
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], ["file"])

    rows = hashes.toDF("h").select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("b"))
    rows.repartitionById(files, F.floor(F.col("b") / FILE_BITS).cast("int")).mapInArrow(run, "file long").collect()
    return StoredSieve(folder, bits)
