"""Archives of a delivery: which tables go in, and safe extraction."""

from __future__ import annotations

import os
import shutil
import stat
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQUENCES = (".fa", ".fasta", ".fa.gz", ".fai")


class UnsafeArchive(ValueError):
    pass


def extract_zip(archive: str, folder: str, most_bytes: int = 1 << 40) -> list[str]:
    """Extract into a new folder; the names, sorted. Absolute names, ``..``, links, repeated names and more than ``most_bytes`` raise before anything is written."""
    with zipfile.ZipFile(archive) as z:
        names, total = set(), 0
        for info in z.infolist():
            path = PurePosixPath(info.filename.replace("\\", "/"))
            if path.is_absolute() or ".." in path.parts or not path.parts or path.parts[0].endswith(":"):
                raise UnsafeArchive(f"unsafe name {info.filename!r}")
            if stat.S_ISLNK(info.external_attr >> 16):
                raise UnsafeArchive(f"link {info.filename!r}")
            if str(path) in names:
                raise UnsafeArchive(f"repeated name {info.filename!r}")
            names.add(str(path))
            total += info.file_size
            if total > most_bytes:
                raise UnsafeArchive("too large")
        os.makedirs(folder)
        out = []
        for info in z.infolist():
            path = PurePosixPath(info.filename.replace("\\", "/"))
            target = os.path.join(folder, *path.parts)
            if info.is_dir():
                os.makedirs(target, exist_ok=True)
                continue
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with z.open(info) as source, open(target, "wb") as sink:
                shutil.copyfileobj(source, sink)
            out.append(str(path))
    return sorted(out)


def delivered(manifest: DataFrame, with_sequences: bool) -> DataFrame:
    """The rows of a manifest (relpath, …) that a delivery has: all, or all but sequence files."""
    name = F.lower("relpath")
    sequence: Column = F.lit(False)
    for ending in SEQUENCES:
        sequence = sequence | name.endswith(ending)
    return manifest if with_sequences else manifest.filter(~sequence)


def add_package(tables: dict[str, DataFrame], keys: dict[str, str], names: DataFrame, key: str) -> dict[str, DataFrame]:
    """Of each table the rows whose key column (by table) is among the names: what a later addition delivers."""
    wanted = names.select(key).distinct()
    return {t: df.join(wanted.withColumnRenamed(key, keys[t]), keys[t], "left_semi") if t in keys else df for t, df in tables.items()}
