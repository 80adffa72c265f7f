"""The catalogue of a folder of evidence: every file has a row, whatever its size or state."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.paths import classify
from tidelog.functions.shared import materialize

# States of a file.
COLLECTED, UNREADABLE, DENIED, BROKEN, OUTSIDE = "collected", "unreadable", "permission_denied", "broken_symlink", "out_of_bounds_symlink"
ENTRY = "relative_path string, source_path string, is_folder boolean, size_bytes long, permissions string, modified_us long, accessed_us long, status string, error string, link_target string"
DIGESTS = ["md5", "sha256", "sha512"]
CHUNK = 1 << 20
#: Bytes of files that a task reads, about; larger files have a task of their own.
TASK_BYTES = 512 << 20


def entry(root: str, path: str) -> dict:
    """The row of one entry of a folder: what can be told without reading it. A link is followed inside the root only."""
    row = dict.fromkeys([f.split()[0] for f in ENTRY.split(", ")])
    row |= {"relative_path": os.path.relpath(path, root).replace(os.sep, "/"), "source_path": path, "is_folder": False, "size_bytes": 0, "status": COLLECTED}
    try:
        if os.path.islink(path):
            row["link_target"] = os.readlink(path)
            real = os.path.realpath(path)
            if os.path.commonpath([real, os.path.realpath(root)]) != os.path.realpath(root):
                return row | {"status": OUTSIDE, "error": f"the link leads outside: {row['link_target']}"}
            if not os.path.exists(real):
                return row | {"status": BROKEN, "error": "the target of the link does not exist"}
            if os.path.isdir(real):
                return row | {"is_folder": None}  # a folder is walked where it stands, not through links
        s = os.stat(path)
    except PermissionError as e:
        return row | {"status": DENIED, "error": str(e)}
    except OSError as e:
        return row | {"status": UNREADABLE, "error": str(e)}
    row |= {"size_bytes": s.st_size, "permissions": f"{stat.S_IMODE(s.st_mode):04o}", "modified_us": s.st_mtime_ns // 1000, "accessed_us": s.st_atime_ns // 1000, "is_folder": stat.S_ISDIR(s.st_mode)}
    if not (row["is_folder"] or stat.S_ISREG(s.st_mode)):
        row |= {"status": UNREADABLE, "error": "no regular file"}  # opening a pipe or device could wait for ever
    return row


def digests(path: str, opened: Callable = open) -> dict:
    """The digests of a file, read in chunks; status and error where it cannot be read."""
    made = [hashlib.new(n) for n in DIGESTS]
    try:
        with opened(path, "rb") as f:
            while part := f.read(CHUNK):
                for h in made:
                    h.update(part)
    except PermissionError as e:
        return dict.fromkeys(DIGESTS) | {"status": DENIED, "error": str(e)}
    except OSError as e:
        return dict.fromkeys(DIGESTS) | {"status": UNREADABLE, "error": str(e)}
    return {n: h.hexdigest() for n, h in zip(DIGESTS, made)} | {"status": COLLECTED, "error": None}


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    """Entries below a folder that all executors see, level by level, each level's folders listed side by side."""
    names = [f.split()[0] for f in ENTRY.split(", ")]
    kinds = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]]) for f in ENTRY.split(", ")])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    found = sorted(e.path for e in os.scandir(folder))
                except OSError as e:
                    state = DENIED if isinstance(e, PermissionError) else UNREADABLE
                    found, rows = [], [dict.fromkeys(names) | {"relative_path": os.path.relpath(folder, root), "source_path": folder, "size_bytes": 0, "status": state, "error": str(e)}]
                else:
                    rows = [entry(root, p) for p in found]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    folders, every = spark.createDataFrame([(root,)], "source_path string"), None
    while True:
        level = materialize(folders.mapInArrow(listed, ENTRY), "entries")
        every = level if every is None else every.unionByName(level)
        below = level.filter("is_folder")
        n = below.count()
        if n == 0:
            return every
        folders = below.select("source_path").repartition(max(1, min(n, 1000)))


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, source_path, category, artifact_type, is_known, size_bytes, permissions, modified_us, accessed_us, md5, sha256, sha512, status, error, link_target: a row a file.

    For a folder that all executors see (a mounted share): empty files, files of any size, unreadable ones and links
    have rows with their state, and one bad file stops nothing. Files are read in chunks, dealt by size. For a store
    that Spark alone reaches, files up to 2 GB, as `binaryFile` reads them.
    """
    url = urlparse(root)
    if url.scheme not in ("", "file"):
        return in_store(spark, root)
    top = os.path.abspath(unquote(url.path) if url.scheme else root)
    entries = list_folders(spark, top).filter("is_folder is null or not is_folder")
    readable = (F.col("status") == COLLECTED) & F.col("is_folder").isNotNull()
    total = entries.filter(readable).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(int(total[0] // TASK_BYTES) + 1 + int(total[1] // 10_000), 100_000))
    large = F.col("size_bytes") > TASK_BYTES
    alone = F.when(large, F.col("source_path"))  # with this key a large file shares its task by chance only
    dealt = entries.filter(readable).repartition(tasks + 8, F.coalesce(alone, F.pmod(F.xxhash64("source_path"), F.lit(tasks)).cast("string")))
    names = [*(f.split()[0] for f in ENTRY.split(", ")), *DIGESTS]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digests(p) for p in batch.column(1).to_pylist()]
            kept = [batch.column(k) for k in range(batch.num_columns) if names[k] not in ("status", "error")]
            more = [pa.array([d[n] for d in found], pa.string()) for n in ("status", "error", *DIGESTS)]
            order = [n for n in names[: batch.num_columns] if n not in ("status", "error")] + ["status", "error", *DIGESTS]
            yield pa.RecordBatch.from_arrays([*kept, *more], order).select(names)

    hashed = dealt.mapInArrow(read, f"{ENTRY}, {', '.join(f'{d} string' for d in DIGESTS)}")
    others = entries.filter(~readable).withColumns({d: F.lit(None).cast("string") for d in DIGESTS})
    return _named(hashed.unionByName(others))


def in_store(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path, none = F.col("path"), F.lit(None).cast("string")
    relative = F.regexp_replace(F.substring_index(path, root.rstrip("/").rpartition("/")[2] + "/", -1), "^/+", "")
    rows = files.select(
        relative.alias("relative_path"), path.alias("source_path"), F.col("length").alias("size_bytes"), none.alias("permissions"), F.unix_micros("modificationTime").alias("modified_us"), F.lit(None).cast("long").alias("accessed_us"),
        F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512"), F.lit(COLLECTED).alias("status"), none.alias("error"), none.alias("link_target"),
    )
    return _named(rows)


def _named(rows: DataFrame) -> DataFrame:
    category, kind, known = classify(F.col("relative_path"))
    return rows.select("relative_path", "source_path", category.alias("category"), kind.alias("artifact_type"), known.alias("is_known"), "size_bytes", "permissions", "modified_us", "accessed_us", *DIGESTS, "status", "error", "link_target")
