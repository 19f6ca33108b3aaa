"""Lines of files that grow: a source of Spark's Python data source interface that reads on from byte offsets.

An offset holds, for every file below a folder, the place after its last whole line. A batch is the bytes between two
offsets, cut into ranges that tasks read; a line belongs to the range in which it begins. What follows a file's last line
end is kept back until its line is whole. Offsets are kept by the stream's checkpoint, so a restart reads no line twice. A
file that has become shorter is taken for a new one and read from its beginning.

Files are opened by pyarrow's file systems, by the folder's address.
"""

from __future__ import annotations


from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, begin long, line string"
#: Bytes of a range, bytes that are read at a time, and lines of a batch that is handed on.
RANGE, BLOCK, LINES = 64 << 20, 1 << 20, 10_000


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def whole_lines(system: fs.FileSystem, path: str, size: int, block: int = BLOCK) -> int:
    """The place after the last line end of a file's first `size` bytes, found from the back."""
    with system.open_input_file(path) as f:
        end = size
        while end:
            begin = max(0, end - block)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


def lines_of(system: fs.FileSystem, path: str, first: int, begin: int, stop: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin from `begin` on and before `stop`, of a part from `first` to `end` of whole lines."""
    with system.open_input_file(path) as f:
        at = max(first, begin - 1)
        f.seek(at)
        skip, held = begin > first, b""
        while at < stop or held:
            more = f.read(min(block, end - at - len(held)))
            held += more
            *full, held = held.split(b"\n")
            for line in full:
                if not skip and at >= stop:
                    return
                if not skip:
                    yield at, line
                skip = False
                at += len(line) + 1
            if at >= stop or not more:
                return


class Range(InputPartition):
    def __init__(self, path: str, first: int, begin: int, stop: int, end: int):
        super().__init__(path)
        self.path, self.first, self.begin, self.stop, self.end = path, first, begin, stop, end


class Files:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.ending, self.size = options["path"], options.get("ending", ""), int(options.get("range", RANGE))
        self.known: dict[str, tuple[int, int]] = {}

    def latest(self) -> dict[str, int]:
        """Every file, by its path below the folder, with the place after its last whole line. Only files that have changed in size are opened."""
        system, root = opened(self.folder)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.path.removeprefix(root).lstrip("/")
            hidden = any(part.startswith((".", "_")) for part in name.split("/"))
            if info.type == fs.FileType.File and name.endswith(self.ending) and not hidden:
                size, end = self.known.get(name, (-1, 0))
                if size != info.size:
                    end = whole_lines(system, info.path, info.size)
                found[name] = (info.size, end)
        self.known = found
        return {name: end for name, (_, end) in sorted(found.items())}

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        out = []
        for path, to in end.items():
            at = start.get(path, 0)
            first = 0 if to < at else at
            out += [Range(path, first, i, min(i + self.size, to), to) for i in range(first, to, self.size)]
        return out

    def rows(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no ranges
            return
        system, root = opened(self.folder)
        held: list[tuple[int, bytes]] = []

        def batch() -> pa.RecordBatch:
            texts = [line.removesuffix(b"\r").decode("utf-8", "replace") for _, line in held]
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(held), pa.string()), pa.array([i for i, _ in held], pa.int64()), pa.array(texts, pa.string())], names=["path", "begin", "line"])

        for one in lines_of(system, f"{root}/{part.path}", part.first, part.begin, part.stop, part.end):
            held.append(one)
            if len(held) >= LINES:
                yield batch()
                held.clear()
        if held:
            yield batch()


class Reader(Files, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges({}, self.latest())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class StreamReader(Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.latest()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class AppendedLines(DataSource):
    """Options: path (a folder), ending (of file names), range (bytes of a task's share)."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def appended_lines(spark: SparkSession, folder: str, ending: str = "", stream: bool = True, size: int = RANGE) -> DataFrame:
    """(path, begin, line) of the files below a folder: as a stream, what was appended since the last batch; else all of it."""
    spark.dataSource.register(AppendedLines)
    reader = spark.readStream if stream else spark.read
    return reader.format("appended_lines").option("path", folder).option("ending", ending).option("range", str(size)).load()


def write_lines(rows: DataFrame, folder: str) -> None:
    """Write rows (path, nth, line, open) as files below a folder, lines in order of nth; an open line gets no line end.

    A file is written whole by one task under another name and then moved, so a task may run again.
    """

    def write(batches: Iterator) -> Iterator:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        at, out = None, None

        def close() -> None:
            if out is not None:
                out.close()
                system.move(f"{root}/_{at}", f"{root}/{at}")

        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != at:
                    close()
                    at, out = r["path"], system.open_output_stream(f"{root}/_{r['path']}")
                out.write(r["line"].encode() + (b"" if r["open"] else b"\n"))
        close()
        yield from ()

    some = rows.select("path", "nth", "line", "open").repartition("path").sortWithinPartitions("path", "nth")
    some.mapInArrow(write, "none string").write.format("noop").mode("overwrite").save()


