"""Side tables: small tables that travel to the rows of a large one without shuffling the large one.

The rows of a file-backed table fall into blocks of so many rows of one file. What a later pass has to
know about a block is written to a folder of its own in the shared storage, and the task that reads the
block reads that folder. Each side row is written once and read by the tasks of one block, so the cost
grows with the side table, not with the number of tasks.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.runtime import scratch_path, shuffle_partitions, store

BLOCK = "__block"
BLOCK_ROWS = 8192


def with_blocks(docs: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` and the name of each row's block. A table that is no plain read of files is stored first."""
    docs = docs.drop(BLOCK)
    name = F.concat(F.hex(F.xxhash64(F.col("_metadata.file_path"))), F.lit("_"), (F.col("_metadata.row_index") / rows).cast("long").cast("string"))
    try:
        return docs.withColumn(BLOCK, name)
    except AnalysisException:
        return store(docs, "rows").withColumn(BLOCK, name)


def write_side(side: DataFrame, name: str) -> str:
    """Write ``side`` (with a column :data:`BLOCK`), one folder per block; gives the path for :func:`read_side`."""
    path = scratch_path(side.sparkSession, name)
    side.repartition(shuffle_partitions(side.sparkSession), BLOCK).write.option("compression", "zstd").partitionBy(BLOCK).parquet(path)
    return path


def read_side(path: str, block: str):
    """The block's side rows as an Arrow table, or None if it has none. Runs in a task."""
    system, root = pafs.FileSystem.from_uri(path)
    folder = f"{root}/{BLOCK}={block}"
    if system.get_file_info(folder).type != pafs.FileType.Directory:
        return None
    files = [f.path for f in system.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".parquet")]
    return pads.dataset(files, filesystem=system, format="parquet").to_table()


def runs(values: list):
    """(start, end, value) of the runs of equal values."""
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield start, i, values[start]
            start = i


def released(run):
    """``run`` of ``mapInArrow``, whose worker gives its free memory back to the system at the end of a task.

    A worker waits for its next task with all that its allocators keep, beside the JVM that has the machine meanwhile.
    """

    def tidy(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every system's library has it
        if trim is not None:
            trim(0)

    return tidy


def sliced(batches, rows: int = 1000):
    """Batches of fewer rows, so that what is made of them stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
