"""The EDF data source: byte ranges, headers alone, pushed filters, streams, layout."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

from hypnolake.sources import files, waveform
from test_sources import write_edf


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("edf")
    rng = np.random.default_rng(0)
    (path / "S1").mkdir()
    for ses, (seconds, record_s) in enumerate([(93, 1), (100, 4), (61, 1)], 1):
        n = seconds // record_s * record_s
        write_edf(path / "S1" / f"sub-P{ses}_ses-{ses}.edf", {
            "EEG C3-M2": (64, rng.normal(0, 20, 64 * n), "uV", -200, 200), "SpO2": (1, rng.uniform(80, 99, n), "%", 0, 100),
            "EDF Annotations": (2, np.zeros(2 * n), "", -1, 1), "ECG II": (100, rng.normal(0, 1, 100 * n), "mV", -5, 5),
        }, record_s)
    (path / "notes.txt").write_text("no waveform")
    return path


def rows(df):
    return sorted((os.path.basename(r.path), r.channel, r.epoch, r.unit, r.fs, tuple(np.round(r.samples, 4))) for r in df.collect())


@pytest.mark.parametrize("size", [128 << 20, 9_000, 700, 37])
def test_byte_ranges_give_every_epoch_once(spark, folder, size):
    whole = rows(files.decode_chunks(files.discover(spark, str(folder), content=True)))
    df = waveform.read_chunks(spark, str(folder), partitionBytes=size)
    assert rows(df) == whole and len(whole) == 3 * (4 + 4 + 3)
    if size == 9_000:
        assert df.rdd.getNumPartitions() > 8  # one file is many tasks


def test_epochs_that_records_do_not_divide(spark, folder):
    """Records of 4 s, epochs of 10 s: samples are those of the whole signal, cut every 10 s."""
    path = next(str(p) for p in folder.rglob("*ses-2.edf"))
    (signal,) = [x for s, x in files.edf_signals(open(path, "rb").read()) if s["label"] == "ECG II"]
    got = waveform.read_chunks(spark, path, partitionBytes=5_000, epochSeconds=10).where("channel = 'ecg ii'").orderBy("epoch").collect()
    assert [r.epoch for r in got] == list(range(10))
    assert np.allclose(np.concatenate([r.samples for r in got]), signal, atol=1e-3)


def test_header_scan_reads_the_header_only(spark, folder, tmp_path):
    """Files cut off after their header, one of 300 signals: the scan needs no more."""
    names = {f"c{i}": (1, np.zeros(60), "uV", -1, 1) for i in range(300)}
    write_edf(tmp_path / "sub-W_ses-1.edf", names, 1)
    raw = (tmp_path / "sub-W_ses-1.edf").read_bytes()
    (tmp_path / "sub-W_ses-1.edf").write_bytes(raw[: 256 * 301])
    got = waveform.read_headers(spark, str(tmp_path))
    assert got.count() == 300 and {r.duration_s for r in got.collect()} == {60.0}
    assert waveform.read_headers(spark, str(tmp_path)).where("channel = 'c7'").count() == 1
    want = {tuple(r) for r in files.decode_headers(files.discover(spark, str(folder), content=True)).select("channel", "unit", "fs", "duration_s").where("channel <> 'edf annotations'").collect()}
    assert {tuple(r) for r in waveform.read_headers(spark, str(folder)).select("channel", "unit", "fs", "duration_s").collect()} == want


def test_filters_reach_the_source(spark, folder):
    w = waveform.Wanted()
    assert w.take(In(("channel",), ("spo2", "ecg ii"))) and w.take(EqualTo(("channel",), "spo2"))
    assert w.take(GreaterThan(("epoch",), 0)) and w.take(LessThanOrEqual(("epoch",), 2)) and not w.take(StringContains(("channel",), "x"))
    assert (w.channels, w.first, w.last) == ({"spo2"}, 1, 2)
    df = waveform.read_chunks(spark, str(folder), partitionBytes=9_000)
    some = df.where("channel = 'spo2' AND epoch >= 1 AND epoch < 3")
    assert rows(some) == [r for r in rows(df) if r[1] == "spo2" and r[2] in (1, 2)]
    assert "Filter" not in some._jdf.queryExecution().optimizedPlan().toString() or "isnotnull" in some._jdf.queryExecution().optimizedPlan().toString()
    assert df.where("channel = 'none'").count() == 0 and df.where("channel LIKE 'e%' AND epoch = 0").count() == 6


def test_stream_takes_files_once(spark, folder, tmp_path):
    out, ckpt, inbox = str(tmp_path / "out"), str(tmp_path / "ckpt"), tmp_path / "in"
    inbox.mkdir()
    src = sorted(folder.rglob("*.edf"))
    for k in (0, 1):
        (inbox / src[k].name).write_bytes(src[k].read_bytes())
        os.utime(inbox / src[k].name, (1e9 + k, 1e9 + k))
        waveform.ingest_stream(spark, str(inbox), out, ckpt, buckets=4).awaitTermination()
    got = spark.read.parquet(out)
    assert got.groupBy("path").count().count() == 2 and got.count() == 3 * (4 + 4)


def test_layout_by_channel_and_recording(spark, folder, tmp_path):
    names = spark.createDataFrame([("eeg c3-m2", "c3-m2"), ("spo2", "spo2")], "channel string, std_channel string")
    out = str(tmp_path / "chunks")
    waveform.ingest(spark, str(folder), out, names, buckets=2)
    assert sorted(d for d in os.listdir(out) if "=" in d) == ["std_channel=c3-m2", "std_channel=ecg ii", "std_channel=spo2"]
    one = spark.read.parquet(out).where("std_channel = 'spo2' AND bucket = 0").inputFiles()
    assert all("std_channel" in f for f in one) and spark.read.parquet(out).select(F.countDistinct("path", "session")).first()[0] == 3


def test_no_files(spark, tmp_path):
    assert waveform.read_chunks(spark, str(tmp_path)).count() == 0 and waveform.read_headers(spark, str(tmp_path)).count() == 0
