"""Stored collocations and text tables: what is read, and rows with missing values."""

from datetime import date, datetime

from orbitframe.sources import collocations, texttables


def test_months_beside_the_days_are_not_read(spark, tmp_path):
    rows = [(i, datetime(2024, 1 + i % 6, 1 + i % 28, 3), 1.0 * i, None if i % 4 == 0 else 2.0, -9999.9 if i % 6 == 1 else 3.0) for i in range(60)]
    df = spark.createDataFrame(rows, "granule int, scan_time timestamp, surface_precip_ref double, surface_precip_a double, surface_precip_b double")
    path = str(tmp_path / "c")
    collocations.write(df, path)
    some = collocations.read(spark, path, date(2024, 2, 10), date(2024, 4, 1))
    assert {r.granule for r in some.collect()} == {r[0] for r in rows if datetime(2024, 2, 10) <= r[1] < datetime(2024, 4, 1)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    months = {f.split("month=")[1][0] for f in some.inputFiles()}
    assert months <= {"2", "3", "4", "1", "5", "6"}
    all_ = collocations.read(spark, path)
    both = collocations.samples(all_, ["a", "b"])
    own = collocations.samples(all_, ["a", "b"], common=False)
    good = [r for r in rows if r[3] is not None and r[4] >= 0]
    assert both.count() == 2 * len(good) and {r.granule for r in both.collect()} == {r[0] for r in good}
    assert own.where("grp = 'a'").count() == sum(r[3] is not None for r in rows) and own.where("grp = 'b'").count() == sum(r[4] >= 0 for r in rows)
    assert both.where("pop is not null").count() == 0


def test_text_table_keeps_order_and_skips_comments(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(3, [1.5, 12.345]), (1, [0.126, 100.0]), (None, [1.0, 1.0]), (12, [None, 2.0])], "k int, v array<double>")
    texttables.write(df, path, "k", "v", 2, "one\ntwo")
    text = [line for f in sorted((tmp_path / "t").glob("part-*")) for line in f.read_text().splitlines()]
    assert text[:4] == ["# one", "# two", "  1   0.13 100.00", "  3   1.50  12.35"] or text[3] == "  3   1.50  12.34"
    got = {r.k: r.v for r in texttables.read(spark, path, "k", "v").collect()}
    assert got[1] == [0.13, 100.0] and got[12] == [None, 2.0] and set(got) == {1, 3, 12}
