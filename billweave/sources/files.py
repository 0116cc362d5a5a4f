"""Document trees file by file: complete listings, contents and a sink.

Spark's own file sources leave out files and folders whose names start with "_" or ".".  Here
folders are listed by tasks, level by level: a folder is one row, the folders found in it are
dealt to the tasks of the next level.  A folder is listed whole by one task.  Stores are
those that Arrow knows: local and shared folders, HDFS, S3, GCS.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint

_LISTED = "path string, is_folder boolean, length long, modificationTime timestamp"
_READ_AT_ONCE = 8  # contents in memory


def full_path(root: str) -> str:
    """A folder the way Spark writes paths: with a scheme, and file: without slashes of its own."""
    root = root.rstrip("/")
    if root.startswith("file:"):
        return "file:/" + root.removeprefix("file:").lstrip("/")
    return root if "://" in root else "file:" + root


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder in batch["path"]:
            store, inside = _store(folder)
            found = store.get_file_info(fs.FileSelector(inside, allow_not_found=True))
            rows = [
                (folder + "/" + f.base_name, f.type == fs.FileType.Directory, f.size or 0, f.mtime)
                for f in found
                if f.type in (fs.FileType.Directory, fs.FileType.File)
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "is_folder", "length", "modificationTime"])


def list_files(spark: SparkSession, root: str, skip_folders=()) -> DataFrame:
    """path, length and modificationTime of every file below a folder, whatever its name.

    Folders with one of the skipped names are not entered.  A missing root gives no files.
    """
    found, folders = None, spark.range(1).select(F.lit(full_path(root)).alias("path"))
    while True:
        listed = checkpoint(folders.mapInPandas(_list_folders, _LISTED))
        files = listed.where("not is_folder").select("path", "length", "modificationTime")
        found = files if found is None else found.unionByName(files)
        inner = listed.where("is_folder").select("path")
        if skip_folders:
            inner = inner.where(~F.substring_index("path", "/", -1).isin(*skip_folders))
        if inner.isEmpty():
            return found
        folders = inner.repartition("path")


def _read(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in paths:
        for at in range(0, len(some), _READ_AT_ONCE):
            out = []
            for path in some.iloc[at : at + _READ_AT_ONCE]:
                store, inside = _store(path)
                with store.open_input_stream(inside) as f:
                    out.append(f.read())
            yield pd.Series(out)


def content_of(path: Column) -> Column:
    """The bytes of a file; read only if the column is used, a few files at a time."""
    return F.pandas_udf(_read, "binary")(path)


def write_files(files: DataFrame, root: str) -> None:
    """Write files(path, content) below a folder, each under its own path.

    A file is written whole by one task, and again, to the same end, if that task is lost.
    """
    root = full_path(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = base + "/" + path.lstrip("/")
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    rows = files.select("path", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    rows.mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()
