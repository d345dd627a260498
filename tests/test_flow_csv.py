"""Flow CSV files with different headers, extensions and contents."""

import pytest

from flowsieve.sources import flow_csv


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text("Rate,label,Number\n10,A,1\n11,A,1\n")
    (tmp_path / "b.csv").write_text("Number, label ,Rate \n2,B,20\n")
    (tmp_path / "c.CSV").write_text("label,Rate\nC,30\n")
    return tmp_path


def test_columns_are_taken_by_name(spark, folder):
    rows = flow_csv.read_flow_dir(spark, str(folder)).select("label", "Rate", "Number").collect()
    assert sorted(map(tuple, rows)) == [("A", 10.0, 1.0), ("A", 11.0, 1.0), ("B", 20.0, 2.0), ("C", 30.0, None)]


@pytest.mark.parametrize("text", ["", "Rate,label,Number\n", "Rate,label\n\n"])
def test_files_without_rows_are_refused(spark, folder, text):
    (folder / "d.csv").write_text(text)
    with pytest.raises(flow_csv.FlowSourceError, match="d.csv"):
        flow_csv.read_flow_dir(spark, str(folder))


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for i in range(300):
        head = ["Rate,label", "label,Rate", " label ,Number"][i % 3]
        (tmp_path / f"f {i}.csv").write_text(("\n  \n" if i % 5 == 0 else "") + f"{head}\n1,{i}\n2,{i}\n")
    files = sorted(str(p) for p in tmp_path.glob("*.csv"))
    tracker, group = spark.sparkContext.statusTracker(), "headers"
    spark.sparkContext.setJobGroup(group, "one job for all headers")
    try:
        groups = flow_csv.by_header(spark, files)
        jobs = tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(len, groups)) == [100, 100, 100] and sorted(sum(groups, [])) == files
    assert len(jobs) <= 2  # the listing of many paths is a job of its own
    assert flow_csv.read_flow_csv(spark, files, numeric=["Number"]).count() == 600


def test_a_large_split_is_not_read_through(spark, tmp_path):
    """Splits as large as a partition are left after the first lines: a broken byte far behind is never met."""
    line = "x" * 60
    (tmp_path / "big.csv").write_text("Rate,label\n" + (line + "\n") * 300_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = flow_csv.first_lines(spark, [str(tmp_path / "big.csv")]).collect()
        assert flow_csv.by_header(spark, [str(tmp_path / "big.csv")]) == [[str(tmp_path / "big.csv")]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.header, r["lines"]) for r in got] == [("Rate,label", 2)]


def test_manifest_has_sizes(spark, folder):
    rows = {r.file_name: (r.n_rows, r.bytes, r.total_rows) for r in flow_csv.file_manifest(
        spark.read.option("header", True).option("pathGlobFilter", flow_csv.CSV_GLOB).csv(str(folder))).collect()}
    assert rows == {p.name: (p.read_text().count("\n") - 1, p.stat().st_size, 4) for p in folder.iterdir()}
