"""A stream source with its own offsets, over appended segment files.

A folder holds one text file per producer (names that start with a dot or an
underscore do not count), to which whole lines are appended, one message a line.  An offset is the byte after the last line read
of every segment, and is kept by the query's checkpoint alone: a batch that
is run again reads the same bytes, a restart goes on after the last batch.

The reading itself is done by the executors, a task for each ``PIECE`` bytes of
a segment in a batch.  To limit a batch to whole lines the driver counts the line
ends of the next bytes of the segments that have grown, at most ``rows`` lines a
batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "fleetscope_segments"
SCHEMA = "segment string, position long, data string"
# ---- fixed values: messages a batch, wait between batches -------------------
BATCH_ROWS = 500
EVERY_S = 5
# -----------------------------------------------------------------------------
READ = 1 << 16
PIECE = 16 * READ       # bytes of one task, up to the end of their last line


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    """Bytes [start, end) of one segment; they end with a line."""
    path: str
    segment: str
    start: int
    end: int


def line_end(data: bytes, lines: int) -> tuple[int, int]:
    """(bytes, lines) of the first ``lines`` whole lines of ``data``."""
    whole = data.count(b"\n")
    if whole <= lines:
        return data.rfind(b"\n") + 1, whole
    at = found = 0
    while found < lines:
        n = data.find(b"\n", at)
        if n < 0:
            break
        at, found = n + 1, found + 1
    return at, found


class Folder:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def sizes(self) -> dict[str, int]:
        fs, root = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"}

    def read(self, segment: str, start: int, end: int) -> bytes:
        fs, root = _open(self.path)
        with fs.open_input_file(f"{root}/{segment}") as f:
            return f.read_at(end - start, start)

    def advance(self, segment: str, start: int, size: int, lines: int) -> tuple[int, int]:
        """Position after at most ``lines`` whole lines from ``start`` on, and
        how many those are; a line that is still being written waits."""
        at = start
        got, held = 0, b""
        while got < lines and at + len(held) < size:
            more = self.read(segment, at + len(held), min(size, at + len(held) + READ))
            if not more:
                break
            held += more
            used, n = line_end(held, lines - got)
            at, got, held = at + used, got + n, held[used:]
        return at, got

    def last_line(self, segment: str, size: int) -> int:
        """Position after the last whole line: found from the end on."""
        at = size
        while at > 0:
            low = max(0, at - READ)
            n = self.read(segment, low, at).rfind(b"\n")
            if n >= 0:
                return low + n + 1
            at = low
        return 0

    def pieces(self, segment: str, start: int, end: int) -> Iterator[Piece]:
        """[start, end), which ends with a line, in pieces of about ``PIECE``
        bytes: each ends with the line that its bound falls into."""
        while start < end:
            at = start + PIECE - 1
            while at < end:
                n = self.read(segment, at, min(end, at + READ)).find(b"\n")
                if n >= 0:
                    at += n + 1
                    break
                at += READ
            at = min(at, end)
            yield Piece(self.path, segment, start, at)
            start = at


def lines(piece: Piece) -> Iterator[pa.RecordBatch]:
    """The messages of a piece, a bounded run of bytes at a time."""
    at, held = piece.start, b""
    while at < piece.end:
        data = held + Folder(piece.path).read(piece.segment, at, min(piece.end, at + 16 * READ))
        first, at = at - len(held), min(piece.end, at + 16 * READ)
        whole = data.rfind(b"\n") + 1
        held, data = data[whole:], data[:whole]
        texts = data.split(b"\n")[:-1]
        places, here = [], first
        for t in texts:
            places.append(here)
            here += len(t) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([piece.segment] * len(texts), pa.string()), pa.array(places, pa.int64()),
             pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["segment", "position", "data"])


class SegmentStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, start: str, rows: int):
        self.folder, self.start, self.rows = Folder(path), start, rows
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        """Only a query without a checkpoint asks for it: the end of what is
        there (``newest``) or nothing read (``oldest``)."""
        sizes = self.folder.sizes() if self.start == "newest" else {}
        return {s: self.folder.last_line(s, n) for s, n in sizes.items()}

    def latestOffset(self) -> dict:
        """At most ``rows`` lines on, dealt evenly over the segments that have
        more; what one does not need the others may take."""
        if self.at is None:
            self.at = self.initialOffset()
        sizes, at = self.folder.sizes(), dict(self.at)
        open_, left = sorted(s for s, n in sizes.items() if n > at.get(s, 0)), self.rows
        while open_ and left:
            share, still = max(1, left // len(open_)), []
            for s in open_:
                end, n = self.folder.advance(s, at.get(s, 0), sizes[s], min(share, left))
                left -= n
                if n:
                    at[s] = end
                if n == share and end < sizes[s]:
                    still.append(s)
                if not left:
                    break
            open_ = still
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # after a restart the engine plans the last batch of the checkpoint first
        if self.at is None:
            self.at = dict(end)
        return [p for s, e in sorted(end.items()) for p in self.folder.pieces(s, start.get(s, 0), e)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return lines(partition)

    def commit(self, end: dict) -> None:
        """The checkpoint has the offset; nothing is deleted or marked here."""

    def stop(self) -> None:
        pass


class SegmentReader(DataSourceReader):
    """All whole lines of all segments."""

    def __init__(self, path: str):
        self.folder = Folder(path)

    def partitions(self) -> Sequence[InputPartition]:
        f = self.folder
        return [p for s, n in sorted(f.sizes().items()) for p in f.pieces(s, 0, f.last_line(s, n))]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        return lines(partition) if partition is not None else iter(())      # no segments: no partition


class SegmentSource(DataSource):
    """Options: ``path``; ``start`` (``newest``, the default, or ``oldest``) for
    a query without a checkpoint; ``rows``, the most messages of a batch."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("the option path is missing")
        return path

    def reader(self, schema: StructType) -> DataSourceReader:
        return SegmentReader(self._path())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        start, rows = self.options.get("start", "newest"), int(self.options.get("rows", BATCH_ROWS))
        if start not in ("newest", "oldest") or rows < 1:
            raise ValueError("start is newest or oldest, rows at least one")
        return SegmentStreamReader(self._path(), start, rows)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSource)


def stream(spark: SparkSession, path: str, start: str = "newest", rows: int = BATCH_ROWS) -> DataFrame:
    """Messages (segment, position, data) as they are appended; feed it to
    ``streaming.jobs.metrics_to_table`` and its like."""
    register(spark)
    return spark.readStream.format(NAME).option("start", start).option("rows", rows).load(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """All messages that are there now."""
    register(spark)
    return spark.read.format(NAME).load(path)
