"""SRC5: files of a folder as rows of what admits them, read in pieces by the tasks; and rows written as files.

Paths go through pyarrow's file systems (file, hdfs, s3 and others), in the driver for the listing and in tasks for the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.sources.tables import MEDIA_WINDOW, PDF_WINDOW

PIECE = 1 << 20
#: Bytes of files that a task reads, as far as whole files allow.
TASK_BYTES = 128 << 20
ROW = "path string, filename string, size_bytes long, head binary, checksum string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class FilesReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Files]:
        system, home = opened(self.root)
        one = system.get_file_info(home)
        found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(home, recursive=True))
        files = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        out: list[Files] = []
        room = 0
        for path, size in files:
            if room < size or not out:
                out.append(Files([]))
                room = TASK_BYTES
            out[-1].paths.append((path, size))
            room -= size + (4 << 20)  # opening a file counts too
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.root)
        for path, size in partition.paths:
            digest, head = hashlib.sha256(), b""
            with system.open_input_stream(path) as f:
                while piece := f.read(PIECE):
                    head = head or piece[:PDF_WINDOW]
                    digest.update(piece)
            yield path, path.rsplit("/", 1)[-1], size, head, digest.hexdigest()


class FilesSource(DataSource):
    """A folder's files: path, filename, size_bytes, head (the first bytes) and checksum; no file is held whole."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options["path"])


def admit_files(spark: SparkSession, folder: str, kind: str, max_bytes: int) -> DataFrame:
    """path, filename, size_bytes, checksum, reason (null if admitted) of the pdf or mp4 files under folder, empty ones too."""
    spark.dataSource.register(FilesSource)
    files = spark.read.format("file_heads").option("path", folder).load()
    if kind == "pdf":
        magic = F.contains(F.substring("head", 1, PDF_WINDOW), F.lit(b"%PDF-"))
    else:
        magic = F.contains(F.substring("head", 5, MEDIA_WINDOW - 4), F.lit(b"ftyp"))
    reason = F.when(~F.endswith(F.lower("filename"), F.lit("." + kind)), "UNSUPPORTED_EXTENSION").when(F.col("size_bytes") == 0, "EMPTY_FILE")
    reason = reason.when(F.col("size_bytes") > max_bytes, "FILE_TOO_LARGE").when(~magic, "BAD_SIGNATURE")
    return files.select("path", "filename", "size_bytes", "checksum", reason.alias("reason"))


def write_files(rows: DataFrame, folder: str) -> int:
    """Rows of filename and content (binary) as files under folder, written by the tasks; how many there are."""
    system, home = opened(folder)
    system.create_dir(home, recursive=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, home = opened(folder)
        for part in parts:
            for name, content in zip(part["filename"], part["content"], strict=True):
                with system.open_output_stream(f"{home}/{name}") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(part)]})

    return rows.select("filename", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
