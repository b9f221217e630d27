"""Roles of the register tables, derived from the sample tables.

Each text runs in Spark SQL and in plain SQL; ``{orders}`` and the like stand
for the tables. Every role reads its tables whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # One row per notification, several per case, some death dates missing.
    "r_linelist": """
SELECT o_orderkey AS seq, o_custkey AS case_id,
       CAST(o_custkey % 20 AS INT) AS age,
       CAST(o_orderdate AS DATE) AS open_date,
       CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END
           AS death_date,
       CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'y' ELSE '' END
           AS first_dose,
       CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'y' ELSE '' END AS second_dose,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'y' END AS booster
FROM {orders}""",
    # Doses by province, sex, month, age band and dose number.
    "r_dose_counts": """
SELECT n.n_name AS province,
       CASE WHEN l.l_returnflag = 'A' THEN 'F' WHEN l.l_returnflag = 'R' THEN 'M' END AS sex,
       CAST(year(l.l_shipdate) AS INT) AS year,
       CASE WHEN month(l.l_shipdate) = 12 AND l.l_suppkey % 10 = 0 THEN 'S.I.' ELSE
            CASE month(l.l_shipdate) WHEN 1 THEN 'Enero' WHEN 2 THEN 'Febrero' WHEN 3 THEN 'Marzo'
                 WHEN 4 THEN 'Abril' WHEN 5 THEN 'Mayo' WHEN 6 THEN 'Junio' WHEN 7 THEN 'Julio'
                 WHEN 8 THEN 'Agosto' WHEN 9 THEN 'Septiembre' WHEN 10 THEN 'Octubre'
                 WHEN 11 THEN 'Noviembre' ELSE 'Diciembre' END END AS month_es,
       CASE WHEN l.l_quantity < 10 THEN '0-2' WHEN l.l_quantity < 20 THEN '3-4'
            WHEN l.l_quantity < 30 THEN '5-11' WHEN l.l_quantity < 45 THEN '12-17' ELSE '18+' END
           AS age_band,
       CAST(l.l_quantity AS INT) AS qty,
       CASE WHEN l.l_linenumber IN (1, 4, 7) THEN '1' WHEN l.l_linenumber IN (2, 5) THEN '2'
            ELSE '3' END AS dose
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
     JOIN {nation} n ON s.s_nationkey = n.n_nationkey""",
    # Province by five-year band.
    "r_population": """
SELECT n.n_name AS province,
       CASE CAST(c.c_custkey % 5 AS INT) WHEN 0 THEN '0 a 4' WHEN 1 THEN '5 a 9'
            WHEN 2 THEN '10 a 14' WHEN 3 THEN '15 a 19' ELSE '20 a 24' END AS band5,
       CAST((1 + c.c_custkey % 97) * 2 AS BIGINT) AS n
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    # Ledger with repeated records, ties on the earliest day, unknown places.
    "r_person_dose": """
SELECT l_partkey AS person_id,
       CASE l_linenumber WHEN 1 THEN '1ra' WHEN 2 THEN '2da' WHEN 3 THEN 'Refuerzo'
            WHEN 4 THEN 'Adicional' WHEN 5 THEN 'Unica' ELSE '2da' END AS dose_name,
       CASE WHEN l_suppkey % 25 = 0 THEN 'S.I.'
            ELSE concat('P', CAST(l_suppkey % 25 AS STRING)) END AS province,
       CASE WHEN l_partkey % 3 = 0 THEN '0-2' WHEN l_partkey % 3 = 1 THEN '3-11'
            ELSE '12-17' END AS age_group,
       CASE WHEN l_tax < 0.075 THEN CAST(l_shipdate AS DATE) END AS dose_date
FROM {lineitem}""",
    # Deaths by year and coded cause.
    "r_death_register": """
SELECT CAST(year(o.o_orderdate) AS INT) AS year,
       concat(substr('ABCDGIJPQUVWXYZ', CAST(l.l_partkey % 15 AS INT) + 1, 1),
              lpad(CAST((l.l_suppkey * 7 + l.l_partkey) % 100 AS STRING), 2, '0')) AS cause_code,
       p.p_type AS cause_name,
       CASE WHEN p.p_size <= 25 THEN '01' ELSE '02' END AS age_group,
       CAST(l.l_linenumber AS INT) AS n
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
     JOIN {part} p ON l.l_partkey = p.p_partkey""",
    # Text flags; f_none stays out of the count of several conditions.
    "r_flags": """
SELECT l_orderkey * 10 + l_linenumber AS case_id,
       CASE WHEN l_quantity > 40 THEN '1' ELSE '0' END AS f_a,
       CASE WHEN l_discount > 0.075 THEN '1' ELSE '0' END AS f_b,
       CASE WHEN l_tax > 0.065 THEN '1' WHEN l_tax >= 0.055 THEN NULL ELSE '0' END AS f_c,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '1' ELSE '0' END AS f_none,
       CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS death_date
FROM {lineitem}""",
    # One or more rows per case, some without a condition.
    "r_long_conditions": """
SELECT o_custkey * 100 + CAST(month(o_orderdate) AS INT) AS case_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'c_asthma' WHEN '2-HIGH' THEN 'c_renal'
            WHEN '3-MEDIUM' THEN 'c_other' WHEN '4-NOT SPECIFIED' THEN 'c_none' END AS condition,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS death_date
FROM {orders}""",
    # Regions of many closed rectangles, as many rings as there are customers.
    "r_polygons": """
SELECT concat('NATION_', CAST(c_nationkey AS STRING)) AS region, c_custkey AS ring, v.idx AS idx,
       CAST(c_nationkey AS DOUBLE) + v.dx * (1 + c_custkey % 3) AS x,
       CAST(c_custkey % 50 AS DOUBLE) + v.dy * (1 + c_custkey % 2) AS y
FROM {customer} CROSS JOIN
     (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) AS v(idx, dx, dy)""",
}

# The same role without a join: the corners are written out of each ring's row.
SPARK_VIEWS = {
    "r_polygons": """
SELECT concat('NATION_', CAST(c_nationkey AS STRING)) AS region, c_custkey AS ring, v.idx AS idx,
       CAST(c_nationkey AS DOUBLE) + v.dx * (1 + c_custkey % 3) AS x,
       CAST(c_custkey % 50 AS DOUBLE) + v.dy * (1 + c_custkey % 2) AS y
FROM {customer} LATERAL VIEW inline(array(struct(0, 0, 0), struct(1, 1, 0), struct(2, 1, 1),
     struct(3, 0, 1), struct(4, 0, 0))) v AS idx, dx, dy""",
}

# Stand-ins for the study's dates, diseases and labels on the sample tables.
MONTHS = ("1995-01-01", "2001-12-01")
DAYS = ("1995-01-01", "2001-12-31")
CAP = "2000-12-31"
BASELINE = ("1998-12-01", "2000-01-01")
REPORT_YEAR = ("1999-01-01", "1999-12-31")
DOSES_BEFORE = "2002-01-01"
SNAPSHOT = "2001-06-01"
YEARS = tuple(range(1995, 2002))
RANK_YEAR = 1999
RANK_SINCE = 1997
REGISTER_AGE = "01"
OVERRIDES = ((3, "1996-02-29"), (6, "1997-07-23"))
DISEASES = (
    ("Economy", "cause_name", "ECONOMY", 1997, 1995, 2001),
    ("Small", "cause_name", "SMALL", 1999, 1995, 2001),
    ("Standard", "cause_name", "STANDARD", 1997, 1993, 2001),
    ("Large", "cause_name", "LARGE", 1999, 1995, 2001),
    ("Missing", "cause_name", "NO SUCH NAME", 1999, 1995, 2001),
    ("Covid", "cause_code", "U07", 2001, 1999, 2001),
)
FLAGS = ("f_a", "f_b", "f_c", "f_none")
COUNTED = ("f_a", "f_b", "f_c")
FLAG_LABELS = {
    "NOREPORTADO": "None reported",
    "MULTIPLE": "Multiple comorbidities",
    "f_a": "Condition A",
    "f_b": "Condition B",
    "f_none": "No comorbidities",
}
ROW_LABELS = {
    "NOREPORTADO": "None reported",
    "MULTIPLE": "Multiple comorbidities",
    "c_asthma": "Condition A",
    "c_renal": "Renal",
    "c_none": "No comorbidities",
}
FLAG_AFTER = "1996-06-30"
ROW_PERIOD = ("1996-06-30", "2000-06-30")
REGION_NAMES = {"NATION_1": "Region one", "NATION_7": "Region seven"}
LABEL_POINTS = (("NATION_3", -65.0, None), ("NATION_4", None, -25.1), ("NATION_5", -55.0, -39.0))
INTERVALS = (
    ("Widely Available Testing", "Testing", "1995-03-01", "1996-10-31"),
    ("Limited Testing", "Testing", "1996-11-15", "1997-02-01"),
    ("Economic assistance to citizens", "Social Assistance", "1995-03-23", "1995-08-30"),
    ("Remote Schooling", "NPIs", "1995-03-16", "1996-02-28"),
    ("Partial School closure", "NPIs", "1996-04-19", "1996-04-30"),
    ("Lockdown", "NPIs", "1995-03-20", "1995-06-09"),
    ("12-17 year olds", "Vaccination", "1996-07-08", "2001-12-31"),
    ("Delta", "Dominant Variants", "1996-10-11", "1996-12-21"),
)


# Declared, so that opening a table starts no job to look at its files.
SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,"
    " c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,"
    " p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
    " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
    " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def tables_of(view: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[view])))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role table as a DataFrame."""
    text = SPARK_VIEWS.get(name, VIEWS[name])
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables_of(name)})


def view_sql(name: str) -> str:
    """A role table as SQL over the plain table names."""
    return VIEWS[name].format(**{t: t for t in tables_of(name)}).strip()
