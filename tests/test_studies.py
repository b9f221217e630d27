"""The analyses end to end on a few source rows."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epifold import dims, studies
from epifold.sources import schemas

D = date


def arriving(df, start):
    """With the place of each row in its list."""
    rows = df.collect()
    schema = T.StructType([*df.schema.fields, T.StructField("at", T.LongType())])
    return df.sparkSession.createDataFrame([(*r, start + i) for i, r in enumerate(rows)], schema)


def frame(spark, schema, records):
    """Rows given as dictionaries, other columns NULL."""
    return spark.createDataFrame(
        [tuple(r.get(c) for c in schema.names) for r in records], T.StructType(schema.fields)
    )


def case(i, age, opened, death=None, **more):
    return {
        "IDEVENTOCASO": i, "EDAD_APERTURA": age, "FECHA_APERTURA": opened,
        "FECHA_FALLECIMIENTO": death, **more,
    }


def test_case_curves(spark, tmp_path):
    text = frame(
        spark, schemas.CASES_TEXT_DATES,
        [
            case("1", 1.0, D(2020, 5, 3)), case("1", 1.0, D(2020, 5, 4), "20/05/2020"),
            case("2", 5.0, D(2021, 1, 1), "not known"), case("3616406", 4.0, D(2020, 10, 1), "19/10/2020"),
        ],
    )
    native = frame(
        spark, schemas.CASES,
        [case("3", 15.0, D(2022, 6, 1), D(2022, 6, 9)), case("4", 2.0, D(2023, 1, 1))],
    )
    tables = studies.case_curves(
        arriving(text, 0), arriving(native, 100), str(tmp_path / "work"), order="at"
    )
    cases = {(r["age_group"], r["year_month"]): r["n"] for r in tables["monthly_cases"].collect()}
    assert cases == {
        ("0-2", "2020-05"): 1, ("3-11", "2021-01"): 1, ("3-11", "2020-10"): 1,
        ("12-17", "2022-06"): 1,
    }
    deaths = tables["monthly_deaths"]
    assert deaths.count() == 3 * 34
    got = {(r["age_group"], r["month"]) for r in deaths.where("n > 0").collect()}
    assert got == {
        ("0-2", D(2020, 5, 1)), ("3-11", D(2022, 10, 1)), ("12-17", D(2022, 6, 1)),
    }
    events = tables["monthly_deaths_annotated"].where("month = '2020-05-01' and n = 1")
    assert {r["event"] for r in events.collect()} == {
        "Limited Testing", "Economic assistance to citizens", "Economic assistance to companies",
        "Remote Schooling", "Lockdown", "Unknown",
    }
    studies.write_tables(tables, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out" / "monthly_cases"))
    assert stored.columns == ["Age group", "Year-Month", "Cases"]


def dose(age, month, qty, number, province="Salta", year=2022):
    return {
        "PROVINCIA": province, "DEPARTAMENTO": "x", "SEXO": "F", "ANIO": year, "MES": month,
        "EDAD_ANIOS": age, "CANTIDAD": qty, "DOSIS": number,
    }


PEOPLE = [
    {"provincia_nombre": p, "edad_quinquenal": b, "cantidad": 1000}
    for p in ("Salta", "Ciudad Autónoma de Buenos Aires")
    for b in ("0 a 4", "5 a 9", "10 a 14", "15 a 19", "20 a 24")
]
DOSES = [
    dose("3-4", "Enero", 100, "1"), dose("5-11", "Febrero", 80, "1"), dose("5-11", "Marzo", 90, "2"),
    dose("0-2", "Julio", 50, "1"), dose("12-17", "Enero", 60, "1", "CABA"),
    dose("12-17", "Mayo", 60, "3", "CABA"), dose("12-17", "Mayo", 60, "2", None),
    dose("18+", "Mayo", 999, "1"), dose("0-2", "S.I.", 999, "1"),
]


def test_coverage_and_incidence(spark, tmp_path):
    zero = {f: "0" for f in schemas.CONDITION_FLAGS}
    with_flags = frame(
        spark, schemas.DEATHS_WITH_FLAGS,
        [
            case("1", 5.0, D(2022, 2, 1), "15/02/2022", **{**zero, "ASMA": "1", "SIN_COMORB": "1"}),
            case("2", 5.0, D(2022, 3, 1), "10/03/2022", PRIMERA="x", SEGUNDA="x", **zero),
            case("2", 5.0, D(2022, 3, 1), "11/03/2022", **zero),
            case("3", 1.0, D(2020, 3, 1), "11/03/2020", **{**zero, "DBT": "1", "HTA": "1"}),
        ],
    )
    with_condition = frame(
        spark, schemas.DEATHS_WITH_CONDITION,
        [
            case("4", 13.0, D(2021, 5, 1), D(2021, 6, 1), COMORBILIDAD="Tuberculosis", PRIMERA="x"),
            case("5", 13.0, D(2021, 5, 1), D(2021, 6, 1)),
            case("6", 30.0, D(2021, 5, 1), D(2021, 6, 1), COMORBILIDAD="Prematuridad"),
        ],
    )
    tables = studies.coverage_and_incidence(
        arriving(with_flags, 0), arriving(with_condition, 100), frame(spark, schemas.POPULATION, PEOPLE),
        frame(spark, schemas.DOSE_COUNTS, DOSES), str(tmp_path / "work"), order="at",
    )
    yearly = {r["year"]: tuple(r)[1:] for r in tables["yearly_deaths"].collect()}
    assert yearly == {
        2020: (1, 0, 0, 0, 0, 0), 2021: (0, 0, 0, 0, 2, 0), 2022: (0, 0, 1, 1, 0, 0),
    }
    snapshot = {r["age_group"]: r for r in tables["coverage_at_snapshot"].collect()}
    # 3600 people aged 3 to 11: 180 with a first, 90 with a second dose.
    assert tuple(snapshot["3-11 years old"])[1:] == ("95%", "5%", "2%", "0%", 3600.0)
    rates = {
        (r["age_label"], r["date"], r["dose_label"]): r["incidence"]
        for r in tables["incidence"].collect()
    }
    april = ("3-11 years old", D(2022, 4, 1))
    assert rates[(*april, "0 dose")] == pytest.approx(1e5 * 1 / (3600 - 180))
    assert rates[(*april, "2+ doses")] == pytest.approx(1e5 * 1 / 90)
    assert not any(k[0].startswith("0-2") and k[2] == "1+ doses" for k in rates)
    latest = tables["latest_incidence"]
    assert {r["date"] for r in latest.collect()} == {D(2022, 12, 1)}
    assert latest.count() == 9
    assert tables["latest_coverage"].count() == 12
    got = {r["condition"]: r["n"] for r in tables["comorbidities"].collect()}
    assert got == {
        "Asthma": 1, "None reported": 2, "Multiple comorbidities": 1, "Tuberculosis": 1,
        "Preterm birth": 1,
    }
    studies.write_tables(tables, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out" / "comorbidities"))
    assert stored.columns == ["Comorbidity", "Count"]


def test_provincial_coverage(spark):
    regions = spark.createDataFrame(
        [("Salta",), ("Ciudad Autónoma de Buenos Aires",), ("Elsewhere",)], "region string"
    )
    tables = studies.provincial_coverage(
        frame(spark, schemas.POPULATION, PEOPLE), frame(spark, schemas.DOSE_COUNTS, DOSES), regions
    )
    curves = tables["curves"]
    # Salta, CABA and the rows without a province; four labels for each of 36 months.
    assert curves.count() == 3 * 3 * 4 * 36
    got = {r["region"]: r["cum_n"] for r in tables["snapshot_3-11"].collect()}
    assert got == {"Salta": 90, "Ciudad Autónoma de Buenos Aires": 0, "Elsewhere": None}
    caba = curves.where(
        (F.col("province") == "CABA") & (F.col("age_group") == "12-17")
        & (F.col("month") == F.lit("2022-12-01").cast("date"))
    )
    shares = {r["dose_label"]: r["pct"] for r in caba.collect()}
    assert shares["1+ doses"] == pytest.approx(5.0) and shares["0 dose"] == pytest.approx(95.0)


def test_person_doses_are_stored(spark, tmp_path):
    ledger = frame(
        spark, schemas.PERSON_DOSES,
        [
            {"jurisdiccion_residencia": "Salta", "grupo_etario": "0-2", "id_persona_dw": "1",
             "fecha_aplicacion": D(2022, 1, d), "nombre_dosis_generica": n}
            for d, n in ((3, "1ra"), (2, "Unica"), (9, "Adicional"))
        ],
    )
    stored = studies.person_doses(ledger, str(tmp_path / "doses"))
    got = sorted((r["dose_name"], r["dose_date"], r["n"]) for r in stored.collect())
    assert got == [("1ra", D(2022, 1, 2), 1), ("Refuerzo", D(2022, 1, 9), 1)]


def death(year, code, name, n, group=dims.REGISTER_CHILD_GROUP):
    return {
        "anio": year, "cie10_causa_id": code, "cie10_clasificacion": name, "grupo_edad": group,
        "cantidad": n,
    }


def test_cause_tables(spark, tmp_path):
    register = frame(
        spark, schemas.DEATH_REGISTER,
        [
            death(2005, "B15", "Hepatitis aguda tipo A", 6), death(2022, "U07", "x", 5),
            death(2022, "J12", "Neumonía", 5), death(2022, "P07", "y", 50),
            death(2022, "Z99", "z", 70), death(2022, "A16", "t", 2),
            death(2022, "P07", "y", 900, "02.other"),
        ],
    )
    tables = studies.cause_tables(register)
    ranking = sorted((r["rank"], r["deaths"]) for r in tables["ranking"].collect())
    assert ranking == [(1.0, 50), (2.5, 5), (2.5, 5), (4.0, 2)]
    assert tables["ranking_infectious"].count() == 3
    before = {r["disease"]: tuple(r)[1:] for r in tables["before_after"].collect()}
    assert before["Hepatitis A"] == ("2005-2006", "3.00", "2007-2022", "0.00")
    assert before["Covid"] == ("2020-2022", "1.67", "-", "-")
    assert tables["leading_causes"].count() == 6
    # A column for every year that occurs, or for those asked for.
    assert tables["deaths_by_group"].columns == ["label", "2005", "2022"]
    asked = studies.cause_tables(register, (2005, 2022))["deaths_by_group"]
    assert asked.columns == ["label", *map(str, range(2005, 2023))]
    studies.write_tables(tables, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out" / "before_after"))
    assert stored.columns[0] == "Disease" and stored.count() == 5
