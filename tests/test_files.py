import json
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F
from sample import TEXT, sample

from glossa.plans.profile import RUSSIAN
from glossa.plans.run import main, run, validate, validate_files
from glossa.sources import files


def test_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Ёж".encode("cp1251"))
    (tmp_path / "b.txt").write_bytes("﻿Ёж".encode())
    (tmp_path / "c.txt").write_bytes(b"\x98\xff")
    rows = files.read_texts(spark, str(tmp_path), ("utf-8", "cp1251")).orderBy("doc_id").collect()
    assert [(r.text, r.encoding) for r in rows] == [("Ёж", "cp1251"), ("Ёж", "utf-8"), (None, None)]
    assert files.sha256(spark, str(tmp_path / "none")) == ""


def test_tables_and_lists(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿id,theme\n1,"a, ""b"""\n2,\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_lexicon(spark, str(tmp_path / "m.csv")).collect()] == [("1", 'a, "b"'), ("2", "")]
    (tmp_path / "s.csv").write_bytes("имя;счет\nа;1\n".encode("cp1251"))
    assert [tuple(r) for r in files.read_csv_flexible(spark, str(tmp_path / "s.csv"), ("utf-8", "cp1251")).collect()] == [("а", "1")]
    (tmp_path / "w.txt").write_text("﻿# x\nслово\n", encoding="utf-8")
    assert [r.value for r in files.read_word_list(spark, str(tmp_path / "w.txt")).orderBy("ord").collect()] == ["# x", "слово"]
    assert files.read_word_list(spark, str(tmp_path / "no")).count() == 0 and files.read_exclusions(spark, None).count() == 0
    df = spark.range(10).withColumnRenamed("id", "n")
    files.save_table(df, f"{tmp_path}/t", export_csv=True, csv_max_rows=5, sample_rows=3)
    assert files.load_table(spark, f"{tmp_path}/t").count() == 10 and spark.read.csv(f"{tmp_path}/t.sample.csv", header=True).count() == 3
    files.remove(spark, f"{tmp_path}/t.parquet")
    assert files.load_table(spark, f"{tmp_path}/t.csv").count() == 3
    with pytest.raises(FileNotFoundError):
        files.load_table(spark, f"{tmp_path}/absent")


def test_workbook_has_all_rows():
    f = BytesIO()
    files.write_workbook(f, iter([("a", ["x", "y"], [(1, "<b>")]), ("long", ["n"], ((i,) for i in range(9))), ("b", ["z"], [])]), sheet_rows=5)
    book = zipfile.ZipFile(f)
    assert "&lt;b&gt;" in book.read("xl/worksheets/sheet1.xml").decode() and "long_3" in book.read("xl/workbook.xml").decode()
    found = [book.read(f"xl/worksheets/sheet{i}.xml").decode() for i in range(2, 6)]
    assert [x.count("<row>") for x in found] == [5, 5, 2, 1] and [x.count("<v>") for x in found] == [4, 4, 1, 0]


def test_figures():
    assert files.bar_svg("t", [("a", 2.0), ("b", 0.0)]).count("<rect") == 2
    assert files.heatmap_svg("t", [("p", "x", 1.0), ("p", "y", 3.0), ("q", "x", 0.0)]).count("<rect") == 3
    assert files.line_svg("t", {"m": [("1", 1.0), ("2", 2.0)], "n": [("1", 0.0)]}).count("<polyline") == 2
    pie = files.pie_svg("t", [("a", 3.0, True), ("b", 1.0, False)])
    assert pie.count("<path") == 2 and "75.0%" in pie and "25.0%" not in pie
    assert all("<svg" in f("t", x) for f, x in ((files.bar_svg, []), (files.heatmap_svg, []), (files.line_svg, {}), (files.pie_svg, [])))


def test_run_writes_everything(spark, tmp_path):
    a = sample(spark)
    a.keep = True
    out = str(tmp_path / "out")
    run(a, out, {"corpus_path": "x"}, make_plots=True, export_names=True)
    meta = json.loads((tmp_path / "out/RUN_METADATA.json").read_text())
    assert (meta["hits_total_raw"], meta["hits_counted_main"], meta["corpus_path"]) == (14, 8, "x")
    assert "MelekhovLink" in spark.read.parquet(f"{out}/TD_HITS_TAGGED.parquet").columns
    assert dict(spark.read.parquet(f"{out}/STATS/overview.parquet").collect())["hits_total_counted"] == "8"
    with zipfile.ZipFile(tmp_path / "out/STATS.xlsx") as book:
        assert len(book.namelist()) == 40
    assert "<polyline" in (tmp_path / "out/PLOTS/dynamics_top_markers_parts.svg").read_text() and "<path" in (tmp_path / "out/PLOTS/top_markers_hero_pie.svg").read_text()
    assert "fill-opacity" in (tmp_path / "out/PLOTS/part_microtheme_heatmap.svg").read_text()
    assert (tmp_path / "out/PLOTS/perspective.svg").exists() and (tmp_path / "out/SHOWCASE/best_examples.parquet").exists()
    assert {r["check"]: r.n for r in validate(a).collect()}["sentences"] == 5


def test_command_line(spark, tmp_path):
    (tmp_path / "corpus.txt").write_text(TEXT, encoding="utf-8")
    (tmp_path / "s1.csv").write_text("id,microtheme,unit,unit_type,comment\nS1,тема,ясно,WORD,\n", encoding="utf-8")
    (tmp_path / "config.json").write_text(json.dumps({"corpus_path": "corpus.txt", "markers": {"s1_csv": "s1.csv"}, "output_dir": "out", "export_csv": False, "save_phrase_quality_report": False}), encoding="utf-8")
    config = str(tmp_path / "config.json")
    assert main(["validate", "--config", config]) == 0
    (tmp_path / "bad.csv").write_text("part_id,start\n1,2\n")
    rest = {"markers": {"s1_csv": "s1.csv", "phrases_csv": "none.csv"}, "segmentation": {"parts_csv": "bad.csv", "books_csv": "none.csv"}}
    found = {(r.level, r.check, r.n) for r in validate_files(spark, str(tmp_path), rest).collect()}
    assert found == {("OK", "marker file s1_csv", 1), ("WARN", "marker file phrases_csv", -1), ("WARN", "segmentation parts_csv without start_sent, end_sent", 1), ("WARN", "segmentation books_csv", -1)}
    assert main(["segments", "--config", config]) == 0 and (tmp_path / "out/books.csv").exists()
    assert main(["run", "--config", config, "--corpus", str(tmp_path / "none.txt")]) == 2
    assert RUSSIAN.phrase_gap == 2


def test_counters_are_taken_while_a_table_is_written(spark, tmp_path):
    df = spark.range(25).withColumnRenamed("id", "a")
    found = files.save_observed(df, f"{tmp_path}/t", {"even": F.count_if(F.col("a") % 2 == 0), "most": F.max("a")}, True, 10, 4, {"a": "b"})
    assert found == {"rows": 25, "even": 13, "most": 24} and spark.read.parquet(f"{tmp_path}/t.parquet").columns == ["b"]
    assert spark.read.csv(f"{tmp_path}/t.sample.csv", header=True).count() == 4 and not files.exists(spark, f"{tmp_path}/t.csv")
    for none in (df.limit(0), df.where("a < 0"), spark.createDataFrame([], "a long")):
        assert files.save_observed(none, f"{tmp_path}/none", {"even": F.count_if(F.col("a") % 2 == 0)}, True)["rows"] == 0


def test_metadata_of_a_run_is_that_of_its_tables(spark, tmp_path):
    """Counters from the writes, those of an aggregation, and the tables themselves agree."""
    from glossa.plans import run as R
    from sample import sample

    a = sample(spark)
    a.keep = True
    counters = files.save_observed(a.markers, f"{tmp_path}/m", R.marker_counters()) | files.save_observed(a.tagged, f"{tmp_path}/h", R.hit_counters(a.p))
    plain = R.metadata(a, {})
    assert {k: plain[k] for k in plain if k in counters} == {k: v for k, v in counters.items() if k != "rows"}
    assert plain["hits_total_raw"] == a.tagged.count() and plain["hits_counted_main"] == a.counted.count()
    a.release()
