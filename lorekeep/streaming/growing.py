"""Files that grow while they are read: a stream of their whole lines, and one change per source and batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from io import BufferedReader

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from .. import shipping

BLOCK = 1 << 16


def _opened(folder: str):
    """(file system, folder in it) of an address; what is no local path is opened by the file system of its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file; the first of a growth begins at start, other parts look for the next line."""

    path: str
    start: int
    end: int
    first: bool


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.suffix, self.part = options["path"], options.get("suffix", ""), int(options.get("partBytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {"ends": {}}

    def _end(self, system, path: str, size: int) -> int:
        """Where the last whole line ends: the file is read back from its end, block by block."""
        with system.open_input_file(path) as f:
            at = size
            while at:
                start = max(0, at - BLOCK)
                f.seek(start)
                cut = f.read(at - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                at = start
        return 0

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, folder = _opened(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        files = sorted((i.path, i.size) for i in found if i.is_file and i.path.endswith(self.suffix))
        return {"ends": {path: self._end(system, path, size) for path, size in files}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, to in end["ends"].items():
            known = start["ends"].get(path, 0)
            begin = known if known <= to else 0
            out += [Range(path, a, min(a + self.part, to), a == begin) for a in range(begin, to, self.part)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        with BufferedReader(system.open_input_file(partition.path), BLOCK) as f:
            at = partition.start if partition.first else partition.start - 1
            f.seek(at)
            if not partition.first:
                at += len(f.readline())
            while at < partition.end:
                line = f.readline()
                yield partition.path, at, line.rstrip(b"\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Format `growing_lines`: (path, start, value) of each whole line below a folder, start its place in bytes.

    A line is given once it has its end.  A file that got shorter is read anew from its beginning; one
    rewritten to a greater length is taken as grown.  A file that vanished gives nothing, and is read
    anew if it comes back.  Options: suffix, the end of the names of the files to read; partBytes, the
    bytes of a task.  The offsets, in the query's checkpoint, hold a number for each file.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, start long, value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def growing_lines(spark: SparkSession, folder: str, suffix: str = "", part_bytes: int = 64 << 20) -> DataFrame:
    """The stream of all whole lines of the files below a folder, as they grow."""
    shipping.ship(spark)
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("suffix", suffix).option("partBytes", part_bytes).load(folder)


def changes(lines: DataFrame) -> DataFrame:
    """(path, lines, first, last) of a batch: a source's burst as one change, with the places of its first and last line."""
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.min("start").alias("first"), F.max("start").alias("last"))


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, suffix: str = "", told: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Appends what grew since the last run to out/lines/batch=<id>, and each batch's changes to out/changes/batch=<id>; `told` gets the changes.

    A batch that is run again overwrites its own folders, so that every line is there once.
    """

    def put(batch: DataFrame, number: int) -> None:
        path = f"{out}/lines/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        written = changes(batch.sparkSession.read.parquet(path))
        written.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        if told is not None:
            told(written)

    return growing_lines(spark, folder, suffix).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
