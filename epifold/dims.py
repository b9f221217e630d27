"""Fixed values of the domain: labels, code ranges, calendars and weights."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Age bands
# ---------------------------------------------------------------------------
AGE_LIMITS = (3, 12, 18)
AGE_LABELS = ("0-2", "3-11", "12-17")
AGE_DISPLAY = {
    "0-2": "0-2 years old",
    "3-11": "3-11 years old",
    "12-17": "12-17 years old",
}
# Age bands of the dose table and the study band each belongs to.
DOSE_BANDS = {"0-2": "0-2", "3-4": "3-11", "5-11": "3-11", "12-17": "12-17"}
# Fifths of each five-year band that fall into a study band.
BAND_FIFTHS = (
    ("0 a 4", "0-2", 3),
    ("0 a 4", "3-11", 2),
    ("5 a 9", "3-11", 5),
    ("10 a 14", "3-11", 2),
    ("10 a 14", "12-17", 3),
    ("15 a 19", "12-17", 3),
)
REGISTER_CHILD_GROUP = "01.De a 0  a 14 anios"

# ---------------------------------------------------------------------------
# doses
# ---------------------------------------------------------------------------
DOSES = ("1", "2", "3")
DOSE_NAMES = {"1": "1ra", "2": "2da", "3": "3ra o más"}
DOSE_ALIASES = {"Adicional": "Refuerzo", "Unica": "1ra"}
UNKNOWN_PLACE = "S.I."
ZERO_DOSE = "0 dose"
DOSE_DISPLAY = {"1": "1+ doses", "2": "2+ doses", "3": "3+ doses"}
DOSE_STATUS = ("", "1ra", "2da", "refuerzo")
DOSE_CLASSES = ("d0", "d1", "d2plus")
INCIDENCE_LABELS = {
    "inc0_cum": "0 dose",
    "inc0b_cum": "0-1 dose",
    "inc1e_cum": "1 dose",
    "inc1_cum": "1+ doses",
    "inc2_cum": "2+ doses",
}
LABELLED_INCIDENCE = ("0 dose", "1+ doses", "2+ doses", "3+ doses")
# Series without deaths, left out of the incidence table.
EMPTY_INCIDENCE = (("0-2 years old", "1+ doses"), ("0-2 years old", "2+ doses"))

# ---------------------------------------------------------------------------
# Calendars (ISO dates) and corrections
# ---------------------------------------------------------------------------
DEATH_MONTHS = ("2020-03-01", "2022-12-01")
DEATH_DAYS = ("2020-01-01", "2022-12-31")
DOSE_MONTHS = ("2020-01-01", "2022-12-01")
DATE_CAP = "2022-12-31"
INCIDENCE_WINDOW = ("2021-12-01", "2023-01-01")
INCIDENCE_YEAR = ("2022-01-01", "2022-12-31")
SNAPSHOT = "2022-12-01"
CONDITION_PERIOD = ("2020-01-01", "2022-12-31")
RANK_CHART_SINCE = 2015
DEATH_DATE_FIXES = (("3616406", "2022-10-19"), ("16177350", "2022-07-23"))
MONTHS_ES = {
    "Enero": 1,
    "Febrero": 2,
    "Marzo": 3,
    "Abril": 4,
    "Mayo": 5,
    "Junio": 6,
    "Julio": 7,
    "Agosto": 8,
    "Septiembre": 9,
    "Octubre": 10,
    "Noviembre": 11,
    "Diciembre": 12,
}

# ---------------------------------------------------------------------------
# Provinces and map regions
# ---------------------------------------------------------------------------
REGION_NAMES = {
    "CABA": "Ciudad Autónoma de Buenos Aires",
    "Tierra del Fuego": "Tierra del Fuego, Antártida e Islas del Atlántico Sur",
}
LABEL_POINTS = (
    ("Ciudad Autónoma de Buenos Aires", -55.0, -39.0),
)

# ---------------------------------------------------------------------------
# Cause groups
# ---------------------------------------------------------------------------
OTHERS = "Others"
COVID_CODE = "U07"
COVID_LABEL = "COVID-19"
# short label, label with its code list
CAUSE_GROUPS = {
    "perinatal": (
        "Conditions originating in the perinatal period",
        "Conditions originating in the perinatal period (P00-P96)",
    ),
    "nervous": ("Diseases of the nervous system", "Diseases of the nervous system (G00-G99)"),
    "tuberculosis": ("Tuberculosis", "Tuberculosis (A15-A19)"),
    "bacterial": ("Other bacterial diseases", "Other bacterial diseases (A20-A49)"),
    "intestinal": ("Intestinal infectious diseases", "Intestinal infectious diseases (A00-A09)"),
    "sexual": (
        "Infections with a predominantly sexual mode of transmission",
        "Infections with a predominantly sexual mode of transmission (A50-A64)",
    ),
    "acute_lower": (
        "Other acute lower respiratory infections",
        "Other acute lower respiratory infections (J20-J22)",
    ),
    "external": (
        "Accidents and/or Lung diseases due to external agents",
        "Accidents and/or Lung diseases due to external agents (J60-J70,V01-X59,Y85,Y86)",
    ),
    "chronic_lower": (
        "Chronic lower respiratory diseases",
        "Chronic lower respiratory diseases (J40-J47)",
    ),
    "congenital": ("Congenital malformations", "Congenital malformations (Q00-Q99)"),
    "homicide": (
        "Homicide/Event of undetermined intent",
        "Homicide/Event of undetermined intent (X85-Y09,Y20-Y34)",
    ),
    "suicide": ("Suicide", "Suicide (X60-X84)"),
    "malignant": ("Malignant neoplasms", "Malignant neoplasms (C00-C97)"),
    "heart": ("Diseases of the heart", "Diseases of the heart (I00-I09,I11,I13,I20-I51)"),
    "covid": ("COVID-19", "COVID-19 (U07)"),
    "influenza": ("Influenza and pneumonia", "Influenza and pneumonia (J09-J18)"),
    "respiratory": (
        "Other diseases of the respiratory system",
        "Other diseases of the respiratory system (J00-J06,J30-J39,J67,J70-J98)",
    ),
    "cerebrovascular": ("Cerebrovascular disease", "Cerebrovascular disease (I60-I69)"),
    "neoplasms": ("Neoplasms", "Neoplasms (D00-D48)"),
    "infectious": (
        "Other and unspecified infectious and parasitic diseases",
        "Other and unspecified infectious and parasitic diseases and their sequelae "
        "(A00,A05,A20-A36,A42-A44,A48-A49,A54-A79,A81-A82,A85,A86-B04,B06-B09,B25-B49,B55-B99)",
    ),
}
# Disjoint code ranges: letter, first number, last number, group.
CAUSE_RANGES = (
    ("A", 0, 9, "intestinal"),
    ("A", 15, 19, "tuberculosis"),
    ("A", 20, 49, "bacterial"),
    ("A", 50, 64, "sexual"),
    ("A", 65, 79, "infectious"),
    ("A", 81, 82, "infectious"),
    ("A", 85, 99, "infectious"),
    ("B", 1, 4, "infectious"),
    ("B", 6, 9, "infectious"),
    ("B", 25, 49, "infectious"),
    ("B", 55, 99, "infectious"),
    ("C", 0, 97, "malignant"),
    ("D", 0, 48, "neoplasms"),
    ("G", 0, 99, "nervous"),
    ("I", 0, 9, "heart"),
    ("I", 11, 11, "heart"),
    ("I", 13, 13, "heart"),
    ("I", 20, 51, "heart"),
    ("I", 60, 69, "cerebrovascular"),
    ("J", 0, 6, "respiratory"),
    ("J", 9, 18, "influenza"),
    ("J", 20, 22, "acute_lower"),
    ("J", 30, 39, "respiratory"),
    ("J", 40, 47, "chronic_lower"),
    ("J", 60, 70, "external"),
    ("J", 71, 98, "respiratory"),
    ("P", 0, 96, "perinatal"),
    ("Q", 0, 99, "congenital"),
    ("U", 7, 7, "covid"),
    ("V", 1, 99, "external"),
    ("W", 0, 99, "external"),
    ("X", 0, 59, "external"),
    ("X", 60, 84, "suicide"),
    ("X", 85, 99, "homicide"),
    ("Y", 0, 9, "homicide"),
    ("Y", 20, 34, "homicide"),
    ("Y", 85, 86, "external"),
)
INFECTIOUS_RESPIRATORY = tuple(
    CAUSE_GROUPS[g][1]
    for g in (
        "influenza",
        "covid",
        "chronic_lower",
        "sexual",
        "tuberculosis",
        "bacterial",
        "respiratory",
        "acute_lower",
        "infectious",
    )
)
INFECTIOUS_LONG = CAUSE_GROUPS["infectious"][1]
INFECTIOUS_SHORTENED = (
    "Other and unspecified infectious and parasitic diseases (see legend for ICD10 codes)"
)
INFECTIOUS_REPLACEMENT = {INFECTIOUS_LONG: INFECTIOUS_SHORTENED}
# output label, selector column, selector value, last pre-vaccine year, calendar
BEFORE_AFTER_DISEASES = (
    ("Hepatitis A", "cause_name", "Hepatitis aguda tipo A", 2006, 2005, 2022),
    ("Hepatitis B", "cause_name", "Hepatitis aguda tipo B", 2009, 2005, 2022),
    ("Meningococcus", "cause_name", "Enfermedad meningocócica", 2017, 2005, 2022),
    ("Varicella", "cause_name", "Varicela", 2015, 2005, 2022),
    ("Covid", "cause_code", "U07", 2022, 2020, 2022),
)

# ---------------------------------------------------------------------------
# comorbidities
# ---------------------------------------------------------------------------
NONE_REPORTED = "NOREPORTADO"
MULTIPLE = "MULTIPLE"
FLAG_CONDITIONS = {
    "NOREPORTADO": "None reported",
    "OTRA": "Other",
    "ENF_ONCO_PREVIA": "Oncological disease",
    "ENF_NEURO_PREVIA": "Neurological disease",
    "NAC_PREVIA": "Previous community-acquired pneumonia",
    "PREMATURO": "Preterm birth",
    "SIN_COMORB": "No comorbidities",
    "RESPIRATORIA_CRONICA": "Chronic respiratory disease",
    "HEPATO_CRONICA": "Chronic liver disease",
    "INMUNOS_CONGENITA": "Congenital or acquired immunosuppression",
    "INSF_CARDIACA": "Cardiac insufficiency",
    "INSF_RENAL": "Chronic renal insufficiency",
    "TBC": "Tuberculosis",
    "MULTIPLE": "Multiple comorbidities",
    "ASMA": "Asthma",
    "DIALISIS_AGUDA": "Dialisis",
    "DIALISIS_CRONICA": "Dialisis",
    "BAJO_PESO": "Low body weight",
    "OBESIDAD": "Obesity",
    "DBT": "Diabetes",
    "HTA": "Arterial hypertension",
    "EPOC": "Chronic Obstructive Pulmonary Disease",
    "BRONQUIO_PREVIA": "Previous bronchiolitis",
}
# The spelling of the immunosuppression label follows FLAG_CONDITIONS, so that
# both sources fall into one class.
ROW_CONDITIONS = {
    "NOREPORTADO": "None reported",
    "Otras (especificar en observaciones)": "Other",
    "Enfermedad oncológica": "Oncological disease",
    "Enfermedad neurológica crónica": "Neurological disease",
    "N.A.C. previa": "Previous community-acquired pneumonia",
    "Prematuridad": "Preterm birth",
    "Sin comorbilidades": "No comorbidities",
    "Enfermedad respiratoria crónica": "Chronic respiratory disease",
    "Hepatopatía crónica": "Chronic liver disease",
    "Inmunosupresión congénita o adquirida": "Congenital or acquired immunosuppression",
    "Insuficiencia cardíaca": "Cardiac insufficiency",
    "Insuficiencia renal crónica": "Chronic renal insufficiency",
    "Tuberculosis": "Tuberculosis",
    "MULTIPLE": "Multiple comorbidities",
}

# ---------------------------------------------------------------------------
# Intervention timeline (event, group, first day, last day)
# ---------------------------------------------------------------------------
TIMELINE = (
    ("Restricted access to testing", "Testing", "2022-04-01", "2022-12-31"),
    ("Widely Available Testing", "Testing", "2020-11-01", "2022-03-31"),
    ("Limited Testing", "Testing", "2020-03-01", "2020-10-31"),
    ("Economic assistance to citizens", "Social Assistance", "2020-03-23", "2020-08-30"),
    ("Economic assistance to companies", "Social Assistance", "2020-04-01", "2020-12-31"),
    ("Remote Schooling", "NPIs", "2020-03-16", "2021-02-28"),
    ("On-site schooling with facemasks", "NPIs", "2021-03-01", "2021-11-16"),
    ("On-site schooling", "NPIs", "2021-11-17", "2022-12-31"),
    ("Partial School closure", "NPIs", "2021-04-19", "2021-04-30"),
    ("Lockdown", "NPIs", "2020-03-20", "2020-06-09"),
    ("Partial Lockdown", "NPIs", "2020-06-08", "2020-10-15"),
    ("Social distancing", "NPIs", "2020-10-14", "2021-08-18"),
    ("12-17 year olds", "Vaccination", "2021-07-08", "2023-01-01"),
    ("3-11 year olds", "Vaccination", "2021-10-05", "2023-01-01"),
    ("6 months - 2 year olds", "Vaccination", "2022-07-08", "2023-01-01"),
    ("Gamma+Lambda", "Dominant Variants", "2021-03-29", "2021-10-12"),
    ("Delta", "Dominant Variants", "2021-10-11", "2021-12-21"),
    ("Omicron", "Dominant Variants", "2021-12-20", "2022-04-12"),
    ("BA.2", "Dominant Variants", "2022-04-11", "2022-06-21"),
    ("BA.4/BA.5", "Dominant Variants", "2022-06-20", "2022-11-08"),
    ("BQ.1*", "Dominant Variants", "2022-11-07", "2023-01-01"),
    ("Unknown", "Dominant Variants", "2020-03-01", "2021-03-30"),
)
