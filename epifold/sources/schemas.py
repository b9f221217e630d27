"""Declared schemas of the input tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from epifold import dims


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _D, _DATE = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()

# Case line list; the first layout carries the death date as dd/mm/yyyy text.
CASES_TEXT_DATES = _struct(
    ("IDEVENTOCASO", _S),
    ("EDAD_APERTURA", _D),
    ("FECHA_APERTURA", _DATE),
    ("FECHA_FALLECIMIENTO", _S),
)
CASES = _struct(
    ("IDEVENTOCASO", _S),
    ("EDAD_APERTURA", _D),
    ("FECHA_APERTURA", _DATE),
    ("FECHA_FALLECIMIENTO", _DATE),
)
_DOSE_TEXTS = (("PRIMERA", _S), ("SEGUNDA", _S), ("REFUERZO", _S))
CONDITION_FLAGS = tuple(
    k for k in dims.FLAG_CONDITIONS if k not in (dims.NONE_REPORTED, dims.MULTIPLE)
)
DEATHS_WITH_FLAGS = T.StructType(
    CASES_TEXT_DATES.fields + _struct(*_DOSE_TEXTS, *((f, _S) for f in CONDITION_FLAGS)).fields
)
DEATHS_WITH_CONDITION = T.StructType(
    CASES.fields + _struct(*_DOSE_TEXTS, ("COMORBILIDAD", _S)).fields
)
POPULATION = _struct(("provincia_nombre", _S), ("edad_quinquenal", _S), ("cantidad", _I))
DOSE_COUNTS = _struct(
    ("PROVINCIA", _S),
    ("DEPARTAMENTO", _S),
    ("SEXO", _S),
    ("ANIO", _I),
    ("MES", _S),
    ("EDAD_ANIOS", _S),
    ("CANTIDAD", _I),
    ("DOSIS", _S),
)
PERSON_DOSES = _struct(
    ("jurisdiccion_residencia", _S),
    ("grupo_etario", _S),
    ("fecha_aplicacion", _DATE),
    ("condicion_aplicacion", _S),
    ("orden_dosis", _S),
    ("nombre_dosis_generica", _S),
    ("id_persona_dw", _S),
)
DEATH_REGISTER = _struct(
    ("anio", _I),
    ("jurisdiccion_de_residencia_id", _S),
    ("jurisdiccion_residencia_nombre", _S),
    ("cie10_causa_id", _S),
    ("cie10_clasificacion", _S),
    ("sexo_id", _S),
    ("sexo", _S),
    ("muerte_materna_id", _S),
    ("muerte_materna_clasificacion", _S),
    ("grupo_edad", _S),
    ("cantidad", _I),
)
POLYGONS = _struct(("region", _S), ("ring", T.LongType()), ("idx", _I), ("x", _D), ("y", _D))

# Source column -> column name used by the operators.
CASE_NAMES = {
    "IDEVENTOCASO": "case_id",
    "EDAD_APERTURA": "age",
    "FECHA_APERTURA": "open_date",
    "FECHA_FALLECIMIENTO": "death_date",
    "PRIMERA": "first_dose",
    "SEGUNDA": "second_dose",
    "REFUERZO": "booster",
    "COMORBILIDAD": "condition",
}
POPULATION_NAMES = {"provincia_nombre": "province", "edad_quinquenal": "band5", "cantidad": "n"}
DOSE_COUNT_NAMES = {
    "PROVINCIA": "province",
    "DEPARTAMENTO": "department",
    "SEXO": "sex",
    "ANIO": "year",
    "MES": "month_es",
    "EDAD_ANIOS": "age_band",
    "CANTIDAD": "qty",
    "DOSIS": "dose",
}
PERSON_DOSE_NAMES = {
    "jurisdiccion_residencia": "province",
    "grupo_etario": "age_group",
    "fecha_aplicacion": "dose_date",
    "nombre_dosis_generica": "dose_name",
    "id_persona_dw": "person_id",
}
DEATH_REGISTER_NAMES = {
    "anio": "year",
    "cie10_causa_id": "cause_code",
    "cie10_clasificacion": "cause_name",
    "grupo_edad": "age_group",
    "cantidad": "n",
}
