"""Waveform and annotation files (EDF) held whole in rows: decoding, record ids, coded streams.

``waveform`` reads the same files by byte ranges, for files of any length; later queries read the Parquet chunks, so channel and column pruning is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SIGNAL_CHUNKS, SIGNAL_HEADERS

# Fixed EDF signal-header layout: (field, bytes per signal), in file order.
EDF_FIELDS = (
    ("label", 16), ("transducer", 80), ("unit", 8), ("phys_min", 8), ("phys_max", 8),
    ("dig_min", 8), ("dig_max", 8), ("prefilter", 80), ("per_record", 8), ("reserved", 32),
)
FILE_ID = r"(sub-[^_/]+)_ses-(\d+)"


def discover(spark: SparkSession, folder: str, pattern: str = "*.edf", content: bool = False) -> DataFrame:
    """Files below a folder; content is read only where asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return df if content else df.select("path", "length", "modificationTime")


def parse_ids(df: DataFrame, path: str = "path", pattern: str = FILE_ID) -> DataFrame:
    """Patient folder and integer session out of a file name; NULL session where absent."""
    pick = lambda i: F.regexp_extract(path, pattern, i)
    return df.withColumn("patient", pick(1)).withColumn("session", F.when(pick(2) != "", pick(2).cast("int")))


def edf_header(raw: bytes) -> tuple[dict, list[dict]]:
    """Main header facts and one dict per signal."""
    text = lambda a, n: raw[a : a + n].decode("latin-1").strip()
    n_sig = int(text(252, 4))
    main = {"header_bytes": int(text(184, 8)), "records": int(text(236, 8)), "record_s": float(text(244, 8))}
    signals = [{} for _ in range(n_sig)]
    at = 256
    for name, width in EDF_FIELDS:
        for s in signals:
            s[name] = text(at, width)
            at += width
    for s in signals:
        s["per_record"] = int(s["per_record"])
        s["fs"] = s["per_record"] / main["record_s"]
    return main, signals


def _clean_label(label: str) -> str:
    return label.strip().lower()


def edf_signals(raw: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """Physical samples of each signal (annotation-text signals are skipped)."""
    main, signals = edf_header(raw)
    width = sum(s["per_record"] for s in signals)
    body = np.frombuffer(raw, dtype="<i2", offset=main["header_bytes"])
    n = min(main["records"], len(body) // width) if main["records"] >= 0 else len(body) // width
    grid = body[: n * width].reshape(n, width)
    at = 0
    for s in signals:
        cols = grid[:, at : at + s["per_record"]]
        at += s["per_record"]
        if "annotations" in s["label"].lower():
            continue
        lo, hi, a, b = (float(s[k]) for k in ("dig_min", "dig_max", "phys_min", "phys_max"))
        yield s, (cols.reshape(-1) - lo) * ((b - a) / (hi - lo)) + a


def decode_chunks(files: DataFrame, epoch_s: float = 30.0) -> DataFrame:
    """(path, content) -> one row per channel and epoch; the last epoch may be short."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                for s, x in edf_signals(bytes(raw)):
                    step = max(int(round(s["fs"] * epoch_s)), 1)
                    parts = [x[i : i + step].astype("float32") for i in range(0, len(x), step)]
                    yield pd.DataFrame({
                        "path": path, "channel": _clean_label(s["label"]), "unit": s["unit"], "fs": s["fs"],
                        "epoch": np.arange(len(parts), dtype="int32"), "samples": parts,
                    })

    return files.select("path", "content").mapInPandas(decode, SIGNAL_CHUNKS)


def decode_headers(files: DataFrame) -> DataFrame:
    """Channel list, unit, rate and duration per file, from the header bytes only (their number stands in bytes 184 to 192)."""
    length = F.trim(F.decode(F.substring("content", 185, 8), "US-ASCII")).cast("int")
    head = files.select("path", F.substring(F.col("content"), F.lit(1), length).alias("head"))

    def decode(batches):
        for batch in batches:
            for path, raw in zip(batch["path"], batch["head"]):
                main, signals = edf_header(bytes(raw))
                yield pd.DataFrame({
                    "path": path, "channel": [_clean_label(s["label"]) for s in signals], "unit": [s["unit"] for s in signals],
                    "fs": [s["fs"] for s in signals], "duration_s": main["records"] * main["record_s"],
                })

    return head.mapInPandas(decode, SIGNAL_HEADERS)


def annotation_samples(chunks: DataFrame, streams: str = "(caisr|expert)", epoch_s: float = 30.0) -> DataFrame:
    """Coded streams as rows: path, stream, fs, idx, value (codes are rounded before use)."""
    rows = chunks.where(F.col("channel").rlike(streams)).select(
        "path", F.col("channel").alias("stream"), "fs", "epoch", F.posexplode("samples").alias("_i", "value")
    )
    per_chunk = F.greatest(F.rint(F.col("fs") * epoch_s), F.lit(1))
    return rows.select("path", "stream", "fs", (F.col("epoch") * per_chunk + F.col("_i")).cast("long").alias("idx"), F.col("value").cast("double").alias("value"))


def stage_epochs(samples: DataFrame, stream: str = "stage_caisr") -> DataFrame:
    return samples.where(F.col("stream") == stream).select("path", F.col("idx").cast("int").alias("epoch"), F.rint("value").cast("int").alias("stage"))


def ingest(spark: SparkSession, folder: str, out: str, pattern: str = "*.edf") -> None:
    """Decode once; chunks are laid out by channel so that later scans prune to the channels they use."""
    chunks = parse_ids(decode_chunks(discover(spark, folder, pattern, content=True)))
    chunks.write.mode("append").partitionBy("channel").parquet(out)
