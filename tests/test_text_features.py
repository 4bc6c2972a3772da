import re

import pytest

from hypnolake.plans import tables

TEXTS = [
    "", " ", "  a  b ", "one, two,three\nfour\n\n5 66 ,", "12", "١٢3 é,ü\u00a0x\ty", "a😀1,😀 2\r\n", ",,,", "\n", "x" * 5000 + "7 " * 300, "a\x00b 1",
]


def test_text_counts(spark, tmp_path):
    """Six counts of odd texts, by code points; a null text has none; documents may come twice."""
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (90, None)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = tables.features_wide(spark, str(tmp_path)).collect()
    assert len(got) == len(TEXTS) - 1 + 4 + 1
    for r in got:
        found = [r[f] for f in tables.TEXT_FEATURES]
        if r.rec == 90:
            assert found == [None] * 6
            continue
        t = TEXTS[r.rec]
        words = len(t.split(" "))
        want = [len(t), words, t.count("\n") + 1, len(re.findall("[0-9]", t)), t.count(","), len(t) / words]
        assert found == pytest.approx(want)


def test_plan_scans_for_single_characters(spark, tmp_path, capsys):
    """Only digits need an expression, and it takes runs, not characters."""
    spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plans = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tables, "cut_lineage", lambda df: plans.append(df) or df)
        tables.features_wide(spark, str(tmp_path)).explain()
    text = capsys.readouterr().out
    assert plans and "split(" not in text and text.count("regexp_replace") == text.count("[^0-9]+") > 0
