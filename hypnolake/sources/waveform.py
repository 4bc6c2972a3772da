"""Waveform files (EDF) as a Spark data source: byte ranges of record blocks, headers alone, batch and stream.

``spark.read.format("edf").load(folder)`` gives one row per channel and epoch. A file is cut at byte positions, as text files are: a task
decodes the epochs that begin in its range, so one file of many gigabytes is many tasks and small files share one. Only a file's header and
the records of the task's epochs are read; a filter on ``channel`` or ``epoch`` leaves out what it excludes before it is decoded.

Options: ``mode`` (``chunks``, or ``headers``: one row per channel from header bytes alone), ``pattern``, ``epochSeconds``, ``partitionBytes``, and for streams
``settleSeconds``: a file is taken once it has not changed for so long. Paths are what ``pyarrow.fs`` opens: local, or a store's URI.
"""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from ..schemas import SIGNAL_CHUNKS, SIGNAL_HEADERS
from .files import edf_header, parse_ids

EPOCHS_AT_ONCE = 64  # of all channels, held by a task
_CHUNKS = pa.schema([
    ("path", pa.string()), ("channel", pa.string()), ("unit", pa.string()), ("fs", pa.float64()), ("epoch", pa.int32()), ("samples", pa.list_(pa.float32())),
])
_HEADERS = pa.schema([("path", pa.string()), ("channel", pa.string()), ("unit", pa.string()), ("fs", pa.float64()), ("duration_s", pa.float64())])


@dataclass
class Piece:
    """The part of a file whose epochs begin in [low, high) of its bytes."""

    path: str
    low: int
    high: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


def list_files(folder: str, pattern: str) -> list[tuple[str, int, int]]:
    """(path, bytes, nanoseconds of the last change) of the files below a folder, or of one file."""
    store, root = open_store(folder)
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(pfs.FileSelector(root, recursive=True))
    head = folder[: len(folder) - len(root.rstrip("/"))] if folder.rstrip("/").endswith(root.rstrip("/")) else ""
    return sorted((head + i.path, i.size, i.mtime_ns) for i in found if i.is_file and fnmatch.fnmatch(i.base_name, pattern))


def open_store(path: str) -> tuple[pfs.FileSystem, str]:
    if path.startswith("file:"):
        return pfs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pfs.FileSystem.from_uri(path)
    return pfs.LocalFileSystem(), path


def cut(files: Iterable[tuple[str, int, int]], size: int) -> list[Pieces]:
    """Large files in pieces of ``size`` bytes, small ones together up to it."""
    out: list[Pieces] = []
    held: list[Piece] = []
    room = size
    for path, length, _ in files:
        low = 0
        while low < length:
            high = min(length, low + size)
            if held and high - low > room:
                out.append(Pieces(held))
                held, room = [], size
            held.append(Piece(path, low, high))
            room -= high - low
            low = high
    return [*out, Pieces(held)] if held else out


def read_header(file) -> tuple[dict, list[dict]]:
    """The header and nothing else: 256 bytes tell its length."""
    file.seek(0)
    main = file.read(256)
    return edf_header(main + file.read(max(int(main[184:192].decode("latin-1").strip()) - 256, 0)))


@dataclass
class Wanted:
    """What pushed filters leave: channels (None: all) and a range of epochs."""

    channels: set[str] | None = None
    first: int = 0
    last: int = 2**31 - 1

    def take(self, f: Filter) -> bool:
        """Whether the filter is dealt with here, wholly."""
        column = f.attribute if hasattr(f, "attribute") else None
        if column == ("channel",) and isinstance(f, (EqualTo, In)):
            names = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.channels = names if self.channels is None else self.channels & names
            return True
        if column == ("epoch",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            return True
        return False


def _channels(signals: list[dict], wanted: Wanted) -> list[tuple[int, str, dict]]:
    """(position, cleaned label, header) of the channels wanted; annotation texts are no signals."""
    named = [(i, s["label"].strip().lower(), s) for i, s in enumerate(signals) if "annotations" not in s["label"].lower()]
    return [x for x in named if wanted.channels is None or x[1] in wanted.channels]


def header_rows(path: str, wanted: Wanted) -> pa.RecordBatch:
    store, inner = open_store(path)
    with store.open_input_file(inner) as file:
        main, signals = read_header(file)
        records = main["records"]
        if records < 0:  # not told: from the length
            records = (file.size() - main["header_bytes"]) // (2 * sum(s["per_record"] for s in signals))
    rows = _channels(signals, wanted)
    return pa.RecordBatch.from_pydict({
        "path": [path] * len(rows), "channel": [n for _, n, _ in rows], "unit": [s["unit"] for *_, s in rows], "fs": [s["fs"] for *_, s in rows],
        "duration_s": [records * main["record_s"]] * len(rows),
    }, schema=_HEADERS)


def chunk_rows(piece: Piece, wanted: Wanted, epoch_s: float) -> Iterator[pa.RecordBatch]:
    """Physical samples by channel and epoch, for the epochs whose first record begins inside the piece; the file's last epoch may be short."""
    store, inner = open_store(piece.path)
    with store.open_input_file(inner) as file:
        main, signals = read_header(file)
        width = sum(s["per_record"] for s in signals)
        head, size = main["header_bytes"], 2 * width
        whole = max(file.size() - head, 0) // size if size else 0
        records = min(main["records"], whole) if main["records"] >= 0 else whole
        rows = _channels(signals, wanted)
        if not records or not rows:
            return
        begin = lambda at: min(max(-(-(at - head) // size), 0), records)  # noqa: E731  first record at or after a byte
        own = (begin(piece.low), begin(piece.high))
        if own[0] >= own[1]:
            return
        per_epoch = epoch_s / main["record_s"]  # records, maybe a broken number
        n_epochs = max(-(-s["per_record"] * records // _step(s, epoch_s)) for *_, s in rows)
        # an epoch belongs to the record in which its first sample lies, by the clock
        first = max(int(np.ceil(own[0] / per_epoch - 1e-9)), wanted.first)
        last = min(int(np.ceil(own[1] / per_epoch - 1e-9)) if own[1] < records else n_epochs, n_epochs, wanted.last + 1)
        starts = np.cumsum([0, *[s["per_record"] for s in signals]])
        for e in range(first, last, EPOCHS_AT_ONCE):
            to = min(e + EPOCHS_AT_ONCE, last)
            low = min(e * _step(s, epoch_s) // s["per_record"] for *_, s in rows)
            high = min(max(-(-to * _step(s, epoch_s) // s["per_record"]) for *_, s in rows), records)
            if low >= high:
                continue
            file.seek(head + low * size)
            grid = np.frombuffer(file.read((high - low) * size), "<i2").reshape(-1, width)
            yield _decoded(piece.path, rows, starts, grid, low, e, to, epoch_s)


def _step(signal: dict, epoch_s: float) -> int:
    return max(int(round(signal["fs"] * epoch_s)), 1)


def _decoded(path: str, rows: list[tuple[int, str, dict]], starts: np.ndarray, grid: np.ndarray, low: int, e: int, to: int, epoch_s: float) -> pa.RecordBatch:
    names, units, rates, epochs, samples = [], [], [], [], []
    for i, name, s in rows:
        lo, hi, a, b = (float(s[k]) for k in ("dig_min", "dig_max", "phys_min", "phys_max"))
        x = (grid[:, starts[i] : starts[i + 1]].reshape(-1) - lo) * ((b - a) / (hi - lo)) + a
        step = _step(s, epoch_s)
        for k in range(e, to):
            at = k * step - low * s["per_record"]
            part = x[at : at + step] if at >= 0 else x[:0]
            if len(part):
                names.append(name)
                units.append(s["unit"])
                rates.append(s["fs"])
                epochs.append(k)
                samples.append(part.astype("float32"))
    return pa.RecordBatch.from_arrays([
        pa.array([path] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(units, pa.string()), pa.array(rates, pa.float64()),
        pa.array(epochs, pa.int32()), pa.array(samples, pa.list_(pa.float32())),
    ], schema=_CHUNKS)


@dataclass
class _Reading:
    """What batch and stream readers share."""

    options: dict
    wanted: Wanted = field(default_factory=Wanted)

    def option(self, name: str, default: str) -> str:
        return next((v for k, v in self.options.items() if k.lower() == name.lower()), default)

    @property
    def headers(self) -> bool:
        return self.option("mode", "chunks") == "headers"

    def files(self) -> list[tuple[str, int, int]]:
        return list_files(self.option("path", ""), self.option("pattern", "*.edf"))

    def cut(self, files: list[tuple[str, int, int]]) -> list[Pieces]:
        size = int(self.option("partitionBytes", str(128 << 20)))
        if self.headers:  # a header is a few kilobytes, whatever the file's length
            return [Pieces([Piece(p, 0, n) for p, n, _ in files[i : i + 256]]) for i in range(0, len(files), 256)]
        return cut(files, size)

    def rows(self, part: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in part.pieces:
            if self.headers:
                yield header_rows(piece.path, self.wanted)
            else:
                yield from chunk_rows(piece, self.wanted, float(self.option("epochSeconds", "30")))


class WaveformReader(DataSourceReader):
    def __init__(self, options: dict):
        self.reading = _Reading(dict(options))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.reading.wanted.take(f):
                yield f

    def partitions(self) -> list[Pieces]:
        return self.reading.cut(self.reading.files()) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.reading.rows(partition)


class WaveformStreamReader(DataSourceStreamReader):
    """Files by the time of their last change: an offset is the latest such time taken."""

    def __init__(self, options: dict):
        self.reading = _Reading(dict(options))

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(float(self.reading.option("settleSeconds", "10")) * 1e9)
        return {"changed": max([t for _, _, t in self.reading.files() if t <= settled], default=0)}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return self.reading.cut([f for f in self.reading.files() if start["changed"] < f[2] <= end["changed"]])

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.reading.rows(partition)


class WaveformSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SIGNAL_HEADERS if _Reading(dict(self.options)).headers else SIGNAL_CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return WaveformReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WaveformStreamReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WaveformSource)
    return spark


def read_chunks(spark: SparkSession, folder: str, **options) -> DataFrame:
    return register(spark).read.format("edf").options(**options).load(folder)


def read_headers(spark: SparkSession, folder: str, **options) -> DataFrame:
    """One row per file and channel, from header bytes alone."""
    return read_chunks(spark, folder, mode="headers", **options)


def laid_out(chunks: DataFrame, names: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """Chunks with ``std_channel`` and ``bucket`` (by recording hash), dealt so that a folder of one channel and bucket is one task's.

    ``names`` (channel, std_channel) holds the montage's standard names, a few rows per label; labels it lacks keep their own.
    """
    rows = parse_ids(chunks).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
    if names is None:
        rows = rows.withColumn("std_channel", F.col("channel"))
    else:
        one = names.groupBy(F.col("channel").alias("_c")).agg(F.min("std_channel").alias("_s"))
        rows = rows.join(one, F.col("channel") == F.col("_c"), "left").withColumn("std_channel", F.coalesce("_s", "channel")).drop("_c", "_s")
    return rows.repartition("std_channel", "bucket").sortWithinPartitions("std_channel", "bucket", "path", "epoch")


def ingest(spark: SparkSession, folder: str, out: str, names: DataFrame | None = None, buckets: int = 64, **options) -> None:
    """Decode once, by standard channel and recording hash: later scans read the channels and recordings they use."""
    laid_out(read_chunks(spark, folder, **options), names, buckets).write.mode("append").partitionBy("std_channel", "bucket").parquet(out)


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, buckets: int = 64, **options):
    """New files since the last run, each once; then the query stops."""
    rows = register(spark).readStream.format("edf").options(**options).load(folder)
    rows = parse_ids(rows).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")).withColumn("std_channel", F.col("channel"))
    return rows.writeStream.format("parquet").partitionBy("std_channel", "bucket").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
