"""Readers, writers and tables written once."""

from __future__ import annotations

from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

import pytest

from epifold import functions as fn
from epifold.operators import linelist
from epifold.sources import files, schemas, storage

D = date(2021, 5, 4)


def test_csv_round_trip_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame(
        [("Córdoba", "0 a 4", 5), ("NA", None, None)],
        "provincia_nombre string, edad_quinquenal string, cantidad int",
    )
    path = str(tmp_path / "pop")
    files.write_csv_gzip(df, path)
    assert all(p.name.endswith(".csv.gz") for p in Path(path).glob("part-*"))
    back = files.read_csv(spark, path, schemas.POPULATION, partitions=2)
    got = sorted(tuple(r) for r in back.fillna({"provincia_nombre": "-", "cantidad": 0}).collect())
    # The text NA is a missing value.
    assert got == [("-", None, 0), ("Córdoba", "0 a 4", 5)]


def test_corrupt_lines_are_kept(spark, tmp_path):
    path = tmp_path / "doses.csv"
    path.write_text(
        "PROVINCIA,DEPARTAMENTO,SEXO,ANIO,MES,EDAD_ANIOS,CANTIDAD,DOSIS\n"
        "Salta,x,F,2021,Mayo,3-4,7,1\n"
        "Salta,x,F,20z1,Mayo,3-4,7,1\n",
        encoding="utf-8",
    )
    df = files.read_csv(spark, str(path), schemas.DOSE_COUNTS, keep_corrupt=True)
    got = {r["ANIO"]: r[files.CORRUPT] for r in df.collect()}
    assert got[2021] is None and "20z1" in got[None]


def test_schemas_name_every_flag():
    assert len(schemas.CONDITION_FLAGS) == 21
    assert len(schemas.DEATHS_WITH_FLAGS.fields) == 4 + 3 + 21
    assert len(schemas.DEATH_REGISTER.fields) == 11


def layouts(spark):
    a = spark.createDataFrame(
        [("1", 4.0, D, "04/05/2021"), ("2", 5.0, D, "31/02/2021")], schemas.CASES_TEXT_DATES
    ).withColumn("FECHA_FALLECIMIENTO", fn.parse_dmy("FECHA_FALLECIMIENTO"))
    b = spark.createDataFrame([("1", 4.0, D, D)], schemas.CASES).withColumn("more", F.lit(1))
    names = {c: schemas.CASE_NAMES[c] for c in schemas.CASES.names} | {"at": "at"}
    a = a.withColumn("at", F.col("IDEVENTOCASO").cast("long"))
    return a, b.withColumn("at", F.lit(3).cast("long")), names


def test_ingest_is_written_once(spark, tmp_path):
    a, b, names = layouts(spark)
    path = str(tmp_path / "cases")
    first = linelist.ingest_linelist(a, b, path, names, order="at")
    assert first.columns == ["case_id", "age", "open_date", "death_date", "seq"]
    before = sorted(tuple(r) for r in first.select("seq", "case_id").collect())
    assert len({seq for seq, _ in before}) == 3
    # First source first.
    assert [case for _, case in before] == ["1", "2", "1"]
    again = linelist.ingest_linelist(a.limit(0), b, path, names, order="at")
    assert sorted(tuple(r) for r in again.select("seq", "case_id").collect()) == before


def test_unfinished_table_is_replaced(spark, tmp_path):
    path = tmp_path / "once"
    rows = spark.range(10)
    storage.materialise_once(rows, str(path))
    (path / "_SUCCESS").unlink()
    assert storage.materialise_once(spark.range(4), str(path)).count() == 4
    assert storage.materialise_once(spark.range(9), str(path)).count() == 4


def test_shared_folder_is_the_session_one(spark, shared_dir):
    assert storage.shared_folder(spark) == shared_dir
    assert storage.scratch_path(spark, "t").startswith(f"{shared_dir}/epifold/t-")


def test_cut_ends_the_lineage(spark):
    df = storage.cut(spark.range(5).withColumn("x", F.col("id") * 2))
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 5


def test_report_table_keeps_display_names(spark, tmp_path):
    df = spark.createDataFrame([("0-2", 4)], "age_group string, n int")
    path = str(tmp_path / "report")
    files.write_report(df, path, {"age_group": "Age group", "n": "Cases (monthly)"})
    assert spark.read.parquet(path).columns == ["Age group", "Cases (monthly)"]


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("more,cantidad,provincia_nombre,edad_quinquenal\nx,5,Salta,0 a 4\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(path), schemas.POPULATION).collect()] == [("Salta", "0 a 4", 5)]
    with pytest.raises(ValueError, match="provincia_nombre"):
        path.write_text("cantidad,edad_quinquenal\n5,0 a 4\n", encoding="utf-8")
        files.read_csv(spark, str(path), schemas.POPULATION)


def test_every_header_is_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("provincia_nombre,edad_quinquenal,cantidad\nSalta,0 a 4,5\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("edad_quinquenal,provincia_nombre,cantidad\n0 a 4,Salta,5\n", encoding="utf-8")
    with pytest.raises(Exception, match="header|CSV"):
        files.read_csv(spark, str(tmp_path), schemas.POPULATION).collect()


@pytest.mark.parametrize("partitions", [None, 8])
def test_arrival_follows_files_not_their_sizes(spark, tmp_path, partitions):
    folder = tmp_path / "lists"
    folder.mkdir()
    header = "IDEVENTOCASO,EDAD_APERTURA,FECHA_APERTURA,FECHA_FALLECIMIENTO\n"
    (folder / "a.csv").write_text(header + "".join(f"{i},1,2021-01-01,\n" for i in range(50)), encoding="utf-8")
    (folder / "b.csv").write_text(header + "".join(f"{i % 50},2,2021-01-02,\n" for i in range(5000)), encoding="utf-8")
    a = files.read_csv(spark, str(folder), schemas.CASES, partitions=partitions, position=True)
    names = {c: schemas.CASE_NAMES[c] for c in schemas.CASES.names}
    lines = linelist.ingest_linelist(a, a.limit(0), str(tmp_path / "out"), names)
    assert lines.select("seq").distinct().count() == 5050
    assert {r["age"] for r in linelist.first_record(lines, "case_id").collect()} == {1.0}


def test_unknown_arrival_is_refused(spark, tmp_path):
    a, b, names = layouts(spark)
    with pytest.raises(ValueError, match="order of arrival"):
        linelist.ingest_linelist(a, b, str(tmp_path / "x"), names)


def test_stored_table_of_another_shape_is_refused(spark, tmp_path):
    path = str(tmp_path / "shape")
    storage.materialise_once(spark.range(3), path)
    with pytest.raises(ValueError, match="instead of"):
        storage.materialise_once(spark.range(3).withColumnRenamed("id", "b"), path)


def test_corrections_keep_one_row_each(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    assert sorted(map(tuple, linelist.apply_overrides(rows, [("1", "x"), ("1", "y")], "k", "v").collect())) == [("1", "y"), ("2", "b")]
    fixes = spark.createDataFrame([("1", "x", 2), ("1", "y", 1), (None, "z", 3)], "k string, v string, at int")
    assert sorted(map(tuple, linelist.apply_overrides(rows, fixes, "k", "v", order="at").collect())) == [("1", "x"), ("2", "b")]
    with pytest.raises(Exception, match="several corrections"):
        linelist.apply_overrides(rows, fixes, "k", "v").collect()


def test_scratch_tables_go(spark):
    with storage.Scratch(spark, "t") as scratch:
        scratch.store(spark.range(3), "a")
        kept, root = scratch.keep(spark.range(2)), scratch.root
    assert kept.count() == 2 and not Path(root).exists()
