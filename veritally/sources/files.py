"""File digests and the artifact inventory of a report folder."""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The files a complete report folder holds, and whether each is required.
EXPECTED_ARTIFACTS: tuple[tuple[str, bool], ...] = (
    ("environment.md", True),
    ("environment.json", True),
    ("dataset.md", True),
    ("dataset.lock.json", True),
    ("models/models.md", True),
    ("models/models.json", True),
    ("summary.md", True),
    ("results.json", True),
    ("reliability.png", True),
    ("tradeoff.png", True),
    ("roc_curves.png", True),
    ("score_distributions.png", True),
    ("latency_box.png", True),
    ("run_log.md", True),
    ("resources.json", True),
    ("errors/error_analysis.md", True),
    ("privacy/pii_detection.md", True),
    ("privacy/pii_detection.json", True),
    ("deployment/deployment.md", False),
    ("ablation/summary.md", False),
    ("make_check.txt", False),
)


DIGEST = "name string, path string, sha256 string, bytes bigint, lines bigint"
READ_BYTES = 1 << 20
#: Files are put together in tasks of about so many bytes; a larger file has a task of its own.
TASK_BYTES = 128 << 20


def _filesystem(root: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    scheme, rest = root.split(":", 1) if ":" in root.split("/", 1)[0] else ("file", root)
    if scheme == "file":
        return fs.LocalFileSystem(), os.path.abspath("/" + rest.lstrip("/") if root != rest else rest)
    return fs.FileSystem.from_uri(root)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _DigestReader(DataSourceReader):
    def __init__(self, root: str, glob: str):
        self.root, self.glob = root, glob

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, base = _filesystem(self.root)
        listed = system.get_file_info(fs.FileSelector(base, recursive=True))
        found = sorted((i.path, i.size or 0) for i in listed if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, self.glob))
        tasks: list[_Files] = []
        held = TASK_BYTES
        for path, size in found:
            if held + size > TASK_BYTES:
                tasks.append(_Files([]))
                held = 0
            tasks[-1].paths.append(path)
            held += size
        return tasks or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _filesystem(self.root)
        for path in partition.paths:
            digest, size, lines = hashlib.sha256(), 0, 0
            with system.open_input_stream(path, compression=None) as stream:
                while block := stream.read(READ_BYTES):
                    digest.update(block)
                    size += len(block)
                    lines += block.count(b"\n")
            yield path.rsplit("/", 1)[-1], path, digest.hexdigest(), size, lines


class FileDigests(DataSource):
    """A file is read block by block in one task, so its size does not matter; what is listed is whole."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return DIGEST

    def reader(self, schema) -> DataSourceReader:
        return _DigestReader(self.options["path"], self.options.get("glob", "*"))


def file_digests(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Digest, size and newline count of every file below a folder, empty ones and those of any size too.

    The folder is a local path or an address that pyarrow's file systems know (file, hdfs, s3, gs). Small files share a
    task. `glob` is matched with the name of a file.
    """
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").option("glob", glob).load(root)


def artifact_inventory(
    spark: SparkSession, listing: DataFrame, expected: Sequence[tuple[str, bool]] = EXPECTED_ARTIFACTS
) -> DataFrame:
    """Expected artifacts beside the files that are there (`relative_path` in the listing)."""
    wanted = spark.createDataFrame([tuple(e) for e in expected], "relative_path string, required boolean")
    # The expected list is a constant of a few rows; the listing is cut to it before it moves.
    present = (
        listing.join(F.broadcast(wanted.select("relative_path")), "relative_path", "left_semi")
        .select("relative_path")
        .distinct()
        .withColumn("present", F.lit(True))
    )
    return wanted.join(present, "relative_path", "left").select(
        "relative_path",
        "required",
        F.coalesce("present", F.lit(False)).alias("present"),
        (F.col("required") & F.col("present").isNull()).alias("missing"),
    )
