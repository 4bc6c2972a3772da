import numpy as np
import pytest
from pyspark.sql import functions as F

from hypnolake.operators.joins import DuplicateKeys, assert_unique, interval_join, join_families, range_join
from hypnolake.sources import files, tables
from hypnolake.streaming.incremental import ingest_new_files


def write_edf(path, signals, record_s=30):
    """Minimal file: {label: (fs, samples, unit, lo, hi)}."""
    n = len(signals)
    records = min(len(x) // int(fs * record_s) for fs, x, *_ in signals.values())
    pad = lambda s, w: str(s)[:w].ljust(w).encode("ascii")
    head = pad(0, 8) + pad("X", 80) + pad("X", 80) + pad("01.01.20", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(records, 8) + pad(record_s, 8) + pad(n, 4)
    col = lambda f, w: b"".join(pad(f(k, v), w) for k, v in signals.items())
    head += col(lambda k, v: k, 16) + col(lambda k, v: "", 80) + col(lambda k, v: v[2], 8) + col(lambda k, v: v[3], 8) + col(lambda k, v: v[4], 8)
    head += col(lambda k, v: -32768, 8) + col(lambda k, v: 32767, 8) + col(lambda k, v: "", 80) + col(lambda k, v: int(v[0] * record_s), 8) + col(lambda k, v: "", 32)
    body = b""
    for r in range(records):
        for fs, x, _, lo, hi in signals.values():
            k = int(fs * record_s)
            dig = np.rint((np.asarray(x[r * k : (r + 1) * k]) - lo) / (hi - lo) * 65535 - 32768)
            body += dig.astype("<i2").tobytes()
    path.write_bytes(head + body)


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "S1").mkdir()
    for ses in (1, 2):
        write_edf(tmp_path / "S1" / f"sub-P{ses}_ses-{ses}.edf", {
            "EEG C3-M2": (64, rng.normal(0, 20, 64 * 90), "uV", -200, 200),
            "SpO2": (1, np.full(90, 96.0), "%", 0, 100),
            "stage_caisr": (1 / 30, [5.0, 2.0, 9.0], "", 0, 10),
            "resp_caisr": (1, np.r_[np.zeros(40), np.ones(12), np.zeros(38)], "", 0, 10),
        })
    return tmp_path


def test_edf_round_trip(spark, folder):
    found = files.discover(spark, str(folder), content=True)
    chunks = files.decode_chunks(found).cache()
    counts = {r.channel: r["count"] for r in chunks.groupBy("channel").count().collect()}
    assert counts == {"eeg c3-m2": 6, "spo2": 6, "stage_caisr": 6, "resp_caisr": 6}
    assert chunks.where("channel = 'spo2'").head().samples[0] == pytest.approx(96, abs=0.01)
    heads = files.decode_headers(found).where("channel = 'eeg c3-m2'").head()
    assert (heads.fs, heads.unit, heads.duration_s) == (64.0, "uV", 90.0)
    ann = files.annotation_samples(chunks)
    st = files.stage_epochs(ann).orderBy("path", "epoch").collect()
    assert [r.stage for r in st] == [5, 2, 9, 5, 2, 9]
    resp = ann.where("stream = 'resp_caisr' AND rint(value) = 1")
    assert resp.groupBy("path").agg(F.min("idx"), F.max("idx")).head()[1:] == (40, 51)
    ids = files.parse_ids(found).orderBy("path").select("patient", "session").collect()
    assert [tuple(r) for r in ids] == [("sub-P1", 1), ("sub-P2", 2)]


def test_incremental_stream_takes_each_file_once(spark, folder, tmp_path):
    out = str(tmp_path / "chunks")
    for _ in range(2):
        ingest_new_files(spark, str(folder), out, checkpoint=str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.where("channel = 'spo2'").count() == 6
    assert (tmp_path / "chunks" / "channel=spo2").is_dir()


def test_demographics_and_codes(spark, tmp_path):
    (tmp_path / "demographics.csv").write_text(
        "SiteID,BDSPPatientID,CreationTime,BidsFolder,SessionID,Age,Sex,Race,Ethnicity,BMI,Time_to_Event,Cognitive_Impairment,Last_Known_Visit_Date,Time_to_Last_Visit\n"
        "S1,7,2015-03-01 22:10:00,sub-7,1,67,F,White or Caucasian,Not Hispanic,,900,True,2020-01-02,1700\n"
        "S1,8,03/05/2016,sub-8,1,71,male,Pacific Islander,,31.5,,False,,\n"
    )
    reg = tables.CohortRegistry({"standard": str(tmp_path)})
    d = {r.patient_id: r for r in reg.demographics(spark, "standard").collect()}
    assert (d[7].label, d[7].sex, d[7].race, d[7].bmi, d[7].age) == (1, "Female", "White", None, 67.0)
    assert (d[8].label, d[8].race, d[8].ethnicity, str(d[8].creation_time)) == (0, "Others", "Unavailable", "2016-03-05 00:00:00")
    with pytest.raises(KeyError):
        reg.path("other")


def test_incremental_export_appends_only_new_keys(spark, tmp_path):
    path = str(tmp_path / "features")
    df = spark.createDataFrame([(i, "s", float(i)) for i in range(5)], "rec int, site string, v double")
    tables.export_incremental(df.where("rec < 3"), path, ["rec"])
    tables.export_incremental(df, path, ["rec"])
    assert sorted(r.rec for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        tables.merge_shards([df, df.drop("v")], ["rec"], ["v"])


def test_predictions_and_scores(spark, tmp_path):
    demo = spark.createDataFrame([("a", 1), ("b", 1)], "bids_folder string, session int")
    pred = spark.createDataFrame([("a", 1, 1, 0.8)], "bids_folder string, session int, pred int, prob double")
    got = {r.bids_folder: (r.Cognitive_Impairment, r.Cognitive_Impairment_Probability) for r in tables.with_predictions(demo, pred, ["bids_folder", "session"]).collect()}
    assert got == {"a": (True, 0.8), "b": (None, None)}
    scores = spark.createDataFrame([("reward", 0.1234)], "metric string, value double")
    tables.write_scores(scores, spark.createDataFrame([(60.0, 1)], "age double, n int"), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s/scores")).head()[0] == "reward: 0.123"


def test_joins(spark):
    a = spark.createDataFrame([(i, float(i) / 3) for i in range(30)], "i int, x double")
    b = spark.createDataFrame([(j, float(j) / 2) for j in range(20)], "j int, y double")
    want = {(i, j) for i in range(30) for j in range(20) if abs(i / 3 - j / 2) <= 1.5}
    assert {tuple(r) for r in range_join(a, b, "x", "y", 1.5).select("i", "j").collect()} == want
    p = spark.createDataFrame([("k", t) for t in range(100)], "k string, t int")
    iv = spark.createDataFrame([("k", 3, 9), ("k", 5, 70), ("k", 8, 8)], "k string, a int, b int")
    assert interval_join(p, iv, ["k"], "t", "a", "b", 10).count() == 6 + 65
    with pytest.raises(DuplicateKeys):
        assert_unique(p, ["k"])
    base = spark.createDataFrame([(" 1 ",), ("2",)], "rec string")
    fam = spark.createDataFrame([(1, 5.0)], "rec int, v double")
    assert {r.rec: (r.nk__v, r.nk__matched) for r in join_families(base, {"nk": fam}, ["rec"]).collect()} == {"1": (5.0, 1), "2": (None, 0)}


def test_range_join_of_few_buckets_is_dealt(spark, monkeypatch):
    """Buckets of very many pairs are cut into parts of bounded size over several tasks; no pair is lost or doubled."""
    from hypnolake.operators import joins

    monkeypatch.setattr(joins, "PAIRS_A_KEY", 50)
    monkeypatch.setattr(joins, "PAIRS_A_TASK", 100)
    a = spark.createDataFrame([(i, "pq"[i % 2], float(i % 3) if i % 7 else None) for i in range(60)], "i int, k string, x double").repartition(2)
    b = spark.createDataFrame([(j, "pq"[j % 2], float(j % 4) / 2) for j in range(40)], "j int, k string, y double")
    near = [(i, j) for i in range(60) if i % 7 for j in range(40) if abs(i % 3 - j % 4 / 2) <= 0.5]
    got = range_join(a, b, "x", "y", 0.5).select("i", "j")
    assert sorted(map(tuple, got.collect())) == near and got.select(F.spark_partition_id()).distinct().count() > 4
    keyed = range_join(a, b, "x", "y", 0.5, ["k"], how="left").select("i", "j").collect()
    matched = [(i, j) for i, j in near if i % 2 == j % 2]
    alone = [(i, -1) for i in range(60) if i not in {m[0] for m in matched}]
    assert sorted((r.i, -1 if r.j is None else r.j) for r in keyed) == sorted(matched + alone)
