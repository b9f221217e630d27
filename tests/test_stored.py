"""Types from states, tables that follow their input, deliveries, accounts, and one hot key or ring."""

from __future__ import annotations

import os
import subprocess
import sys
from collections import Counter
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from epifold.operators import coverage, geo, linelist, ranges
from epifold.operators.arrivals import Overtaken, Rule, Store
from epifold.sources import accounting, files, infer, manifest

# ------------------------------------------------------------------------ inferred types

COLUMNS = {
    "flag": (["T", "F", "NA"], "boolean"),
    "n": (["-1", "+20", "0"], "integer"),
    "wide": (["1", "3000000000", ""], "long"),
    "real": (["1", "2.5", "-1e3"], "double"),
    "huge": (["1", "123456789012345678901", "2"], "double"),
    "beyond": (["1e999", "1", "2"], "text"),
    "code": (["01", "02", "10"], "text"),
    "day": (["2021-02-28", "NA", "2020-02-29"], "date"),
    "no_day": (["2021-02-30", "2020-01-01", "2020-01-02"], "text"),
    "time": (["2021-02-28 10:00:00", "2021-02-28T11:30:05.25", "NA"], "timestamp"),
    "mixed": (["2021-02-28", "3", "4"], "text"),
    "word": (["x", "1", "NaN"], "text"),
    "none": (["NA", "", "NA"], "text"),
}


def text_frame(spark, parts=2):
    rows = list(zip(*(v for v, _ in COLUMNS.values())))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS)).repartition(parts)


def test_types_of_columns(spark):
    states = infer.column_states(text_frame(spark))
    got = {r["name"]: r["type"] for r in states.select("name", infer.type_name("fits").alias("type")).collect()}
    assert got == {c: t for c, (_, t) in COLUMNS.items()}
    assert infer.schema_of(states).names == list(COLUMNS)


def test_states_of_files_merge_to_those_of_all(spark):
    df = text_frame(spark).withColumn("file", F.xxhash64("n") % 2)
    apart = infer.column_states(df, by=["file"])
    whole = infer.column_states(df.drop("file"))
    assert sorted(infer.merge_states(apart).collect()) == sorted(whole.collect())
    # Merging is free of order and grouping.
    first = infer.merge_states(apart.where("file = 0")).unionByName(infer.merge_states(apart.where("file <> 0")))
    assert sorted(infer.merge_states(first).collect()) == sorted(whole.collect())


def test_read_with_inferred_types(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = [(1, "a", date(2020, 1, 1), 1.5, "007"), (2, None, None, 2.0, "010"), (3000000000, "NA", date(2021, 1, 1), None, "100")]
    df = spark.createDataFrame(rows, "id long, name string, day date, x double, code string")
    files.write_csv_gzip(df.repartition(3), path)
    read = infer.read_csv_inferred(spark, path)
    assert read.dtypes == df.dtypes
    assert sorted(read.collect(), key=str) == sorted(df.na.replace("NA", None, "name").collect(), key=str)
    plan = infer.column_states(infer.read_text(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan csv") == 1 and "Python" not in plan


def test_states_of_an_empty_table(spark):
    states = infer.column_states(spark.createDataFrame([], "a string, b string"))
    assert [(r["n_known"], r["fits"]) for r in states.collect()] == [(0, infer.ALL)] * 2
    assert [f.dataType.simpleString() for f in infer.schema_of(states)] == ["string", "string"]


# --------------------------------------------------------------- tables that follow input


class Source:
    def __init__(self, spark, folder):
        self.spark, self.path, self.root, self.built = spark, f"{folder}/in", f"{folder}/out", 0

    def add(self, *values):
        self.spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.mode("append").parquet(self.path)

    def read(self):
        return self.spark.read.schema("v int").parquet(self.path)

    def table(self, parameters=None, by="files"):
        def build():
            self.built += 1
            return self.read().select((F.col("v") * 10).alias("v"))

        out = manifest.materialise_current(build, self.root, [self.read()], parameters, by)
        return sorted(r.v for r in out.collect())


def test_changed_input_gives_a_new_table_and_equal_input_no_job(spark, tmp_path):
    s = Source(spark, tmp_path)
    s.add(1, 2)
    assert s.table() == [10, 20] and s.built == 1
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("reuse", "a table that is there")
    manifest.materialise_current(lambda: pytest.fail("built again"), s.root, [s.read()])
    assert list(tracker.getJobIdsForGroup("reuse")) == []
    spark.sparkContext.setJobGroup("other", "")
    s.add(3)
    assert s.table() == [10, 20, 30] and s.built == 2
    assert s.table({"factor": 10}) == [10, 20, 30] and s.built == 3
    assert len(manifest.versions(spark, s.root)) == 3
    manifest.prune(spark, s.root)
    assert len(manifest.versions(spark, s.root)) == 1


def test_what_a_frame_does_with_its_files_counts(spark, tmp_path):
    s = Source(spark, tmp_path)
    s.add(1, 2, 3)

    def stored(least):
        read = s.read().where(F.col("v") >= least)
        return sorted(r.v for r in manifest.materialise_current(lambda: read, s.root, [read]).collect())

    assert (stored(2), stored(3), stored(2)) == ([2, 3], [3], [2, 3])
    assert len(manifest.versions(spark, s.root)) == 2
    mixed = s.read().unionByName(spark.createDataFrame([(9,)], "v int"))
    with pytest.raises(ValueError):
        manifest.fingerprint([mixed])
    assert manifest.fingerprint([mixed], by="auto") == manifest.fingerprint([mixed], by="content")
    assert manifest.fingerprint([s.read()], by="auto") == manifest.fingerprint([s.read()])


def test_content_decides_where_files_are_rewritten(spark, tmp_path):
    s = Source(spark, tmp_path)
    s.add(1, 2)
    assert s.table(by="content") == [10, 20]
    spark.createDataFrame([(2,), (1,)], "v int").repartition(2).write.mode("overwrite").parquet(s.path)
    assert s.table(by="content") == [10, 20] and s.built == 1
    s.add(2)
    assert s.table(by="content") == [10, 20, 20] and s.built == 2


def test_row_fingerprints(spark):
    def of(rows, schema="a string, b string"):
        return manifest.fingerprint_rows(spark.createDataFrame(rows, schema))

    base = of([("x", None), ("y", "z"), ("y", "z")])
    assert base == of([("y", "z"), ("x", None), ("y", "z")])
    others = [
        of([("x", None), ("y", "z")]),
        of([(None, "x"), ("y", "z"), ("y", "z")]),
        of([("x", ""), ("y", "z"), ("y", "z")]),
        of([("x", None), ("y", "z"), ("y", "z")], "a string, c string"),
        of([]),
    ]
    assert len({base, *others}) == 6
    swapped = spark.createDataFrame([(None, "x"), ("z", "y"), ("z", "y")], "b string, a string")
    assert manifest.fingerprint_rows(swapped) == base


def test_file_fingerprints_add_up(spark, tmp_path):
    s = Source(spark, tmp_path)
    s.add(1)
    one = manifest.fingerprint_files(s.read())
    s.add(2)
    both = manifest.fingerprint_files(s.read())
    files_ = s.read().inputFiles()
    parts = [manifest.fingerprint_files(spark.read.schema("v int").parquet(f)) for f in files_]
    assert manifest.merge_fingerprints(*parts) == manifest.merge_fingerprints(*reversed(parts)) == both != one
    with pytest.raises(ValueError):
        manifest.fingerprint_files(spark.range(3))


def test_two_writers_of_one_table(spark, tmp_path):
    s = Source(spark, tmp_path)
    s.add(1)

    def slow():
        # Another job publishes while this one works.
        assert s.table() == [10]
        return s.read().select((F.col("v") * 10).alias("v"))

    out = manifest.materialise_current(slow, s.root, [s.read()])
    assert [r.v for r in out.collect()] == [10] and len(manifest.versions(spark, s.root)) == 1
    assert os.listdir(f"{s.root}/{manifest.WRITING}") == []


KILLED = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from epifold.sources import manifest
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
manifest.publish = lambda *_: os._exit(9)
source = spark.read.schema("v int").parquet({path!r})
manifest.materialise_current(lambda: source.limit(0), {root!r}, [source])
"""


def test_a_killed_writer_leaves_nothing_to_read(spark, tmp_path):
    s = Source(spark, tmp_path)
    s.add(1, 2)
    script = KILLED.format(repo=str(Path(__file__).resolve().parents[1]), path=s.path, root=s.root)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=120)
    assert done.returncode == 9
    assert len(os.listdir(f"{s.root}/{manifest.WRITING}")) == 1 and manifest.versions(spark, s.root) == []
    assert s.table() == [10, 20] and s.built == 1
    manifest.prune(spark, s.root)
    assert not os.path.exists(f"{s.root}/{manifest.WRITING}")


def test_line_lists_follow_their_files(spark, tmp_path):
    schema = "case_id int, age int, seq long"
    for name in ("a", "b"):
        spark.createDataFrame([(1, 5, 1), (2, 6, 2)], schema).write.parquet(f"{tmp_path}/{name}")
    names = {"case_id": "case_id", "age": "age", "seq": "seq"}

    def lines():
        a, b = (spark.read.schema(schema).parquet(f"{tmp_path}/{n}") for n in ("a", "b"))
        return linelist.ingest_linelist(a, b, f"{tmp_path}/out", names, order="seq", current=True)

    assert lines().count() == 4
    spark.createDataFrame([(3, 7, 3)], schema).write.mode("append").parquet(f"{tmp_path}/b")
    assert lines().count() == 5


# ------------------------------------------------------------------------------ deliveries

RULE = Rule("case_id", "seq", best_of=("death",))
LINES = "case_id long, seq long, age int, death string"


def lines_of(spark, n=4000):
    """A third of all rows belong to case 0; the first row of a case may lack its age."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, F.lit(0)).otherwise(i % 97 + 1).alias("case_id"),
        ((i * 7919) % n).alias("seq"),
        F.when(i % 5 > 0, (i % 20).cast("int")).alias("age"),
        F.when(i % 11 == 0, F.concat(F.lit("d"), i.cast("string"))).alias("death"),
    )


def listing(root):
    return {p: p.stat().st_mtime_ns for p in Path(root, "data").rglob("*.parquet")}


def test_three_deliveries_equal_one_run(spark, tmp_path):
    rows = lines_of(spark)
    store = Store(spark, f"{tmp_path}/store", RULE, rows.schema, buckets=8)
    assert store.rows().count() == 0
    for k in (1, 2, 0):
        store.apply(rows.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == k))
    whole = sorted(map(tuple, linelist.dedup_linelist(rows, "case_id", "seq", ["death"]).collect()))
    assert sorted(map(tuple, store.rows().collect())) == whole
    # A delivery that comes twice changes nothing.
    store.apply(rows.where("seq < 500"))
    assert sorted(map(tuple, store.rows().collect())) == whole
    before = listing(f"{tmp_path}/store")
    store.prune()
    after = listing(f"{tmp_path}/store")
    assert set(after) < set(before) and sorted(map(tuple, store.rows().collect())) == whole


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    rows = lines_of(spark)
    store = Store(spark, f"{tmp_path}/store", RULE, rows.schema, buckets=8)
    assert store.apply(rows) == list(range(8))
    held, before = store.version()[1], listing(f"{tmp_path}/store")
    late = spark.createDataFrame([(5, -1, 3, "first")], LINES)
    (touched,) = store.apply(late)
    now = store.version()[1]
    assert {b for b in held if now[b] != held[b]} == {touched}
    after = listing(f"{tmp_path}/store")
    assert all(after[p] == t for p, t in before.items())
    assert [tuple(r) for r in store.rows().where("case_id = 5").collect()] == [(5, -1, 3, "first")]
    # NULL is a key as any other, and an empty delivery touches nothing.
    store.apply(spark.createDataFrame([(None, 2, 1, None), (None, 1, None, None)], LINES))
    assert [tuple(r) for r in store.rows().where("case_id is null").collect()] == [(None, 1, None, None)]
    assert store.apply(rows.limit(0)) == []


def test_dead_and_overtaken_writers(spark, tmp_path, monkeypatch):
    rows = lines_of(spark, 300)
    store = Store(spark, f"{tmp_path}/store", RULE, rows.schema, buckets=4)
    store.apply(rows.where("seq < 100"))
    held = sorted(map(tuple, store.rows().collect()))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            store.apply(rows.where("seq >= 100"))
    assert sorted(map(tuple, store.rows().collect())) == held
    publish = Store._publish

    def late(self, number, folders):
        with monkeypatch.context() as m:
            m.setattr(Store, "_publish", publish)
            Store(spark, self.root, RULE, rows.schema, buckets=4).apply(rows.where("seq between 100 and 199"))
        publish(self, number, folders)

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", late)
        with pytest.raises(Overtaken):
            store.apply(rows.where("seq >= 200"))
    store.apply(rows.where("seq >= 200"))
    want = sorted(map(tuple, linelist.dedup_linelist(rows, "case_id", "seq", ["death"]).collect()))
    assert sorted(map(tuple, store.rows().collect())) == want
    with pytest.raises(ValueError):
        Store(spark, f"{tmp_path}/store", RULE, rows.schema, buckets=5).rows()


# -------------------------------------------------------------------------------- accounts


def test_accounts_add_up(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (None, None), (50, "c")], "n int, s string")
    rules = {"incomplete": accounting.incomplete(df, "n"), "large": F.col("n") > 9, "nameless": F.col("s").isNull(), "never": F.lit(False)}
    counts = accounting.write_accounted(df, str(tmp_path / "kept"), rules)
    assert counts == {"read": 5, "kept": 1, "rejected_incomplete": 2, "rejected_large": 1, "rejected_nameless": 1, "rejected_never": 0}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "kept")).collect()] == [(1, "a")]
    empty = accounting.write_accounted(df.limit(0), str(tmp_path / "none"), {"any": accounting.incomplete(df)})
    assert empty == {"read": 0, "kept": 0, "rejected_any": 0}


def test_accounts_that_do_not_add_up_are_an_error():
    class Counted:
        def __init__(self, **counts):
            self.get = counts

    with pytest.raises(accounting.Unbalanced):
        accounting.Accounts(Counted(read=5, rejected_a=1), Counted(kept=3), ("a",)).counts()


# --------------------------------------------------------------------- one hot key or ring


def hot_points(spark, n=20_000):
    """All rows but some have one key, a fifth of them one point, and some neither."""
    i = F.col("id")
    return spark.range(n).select(
        "id",
        F.when(i % 50 == 0, F.lit(None)).when(i % 49 == 0, F.lit("b")).otherwise(F.lit("a")).alias("k"),
        F.when(i % 5 == 0, F.lit(77)).when(i % 101 == 0, F.lit(None)).otherwise((i * 7919) % 9973).alias("at"),
        F.when(i % 7 > 0, i % 13).alias("v"),
    )


def test_running_sums_of_a_hot_key_are_spread(spark, monkeypatch):
    df = hot_points(spark)
    dealt = []
    keep = ranges.cut
    monkeypatch.setattr(ranges, "cut", lambda d: dealt.append(keep(d)) or dealt[-1])
    got = {r["id"]: r["s"] for r in ranges.running_sums_of_rows(df, ["k"], "at", {"s": "v"}, ranges=8).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    total = {}
    for k in (None, "a", "b"):
        mine = sorted((r for r in rows if r["k"] == k), key=lambda r: (r["at"] is None, r["at"] or 0))
        running, total[k] = None, {}
        for r in mine:
            running = running if r["v"] is None else (running or 0) + r["v"]
            total[k][r["at"]] = running
    assert all(got[r["id"]] == total[r["k"]][r["at"]] for r in rows)
    sizes = [r["count"] for r in dealt[0].where("k = 'a'").groupBy("_range").count().collect()]
    # Several tasks, none with most of the key; equal points came as one row.
    assert len(sizes) > 4 and max(sizes) < sum(sizes) / 3 and sum(sizes) < 10_000


def test_ranks_of_a_hot_key(spark, monkeypatch):
    df = hot_points(spark)
    rows = df.collect()
    dealt = []
    keep = ranges.cut
    monkeypatch.setattr(ranges, "cut", lambda d: dealt.append(keep(d)) or dealt[-1])
    for keys in ([], ["k"]):
        got = {r["id"]: r["rank"] for r in ranges.average_ranks_of_rows(df, "at", keys, ranges=8).collect()}
        for k in {r["k"] if keys else None for r in rows}:
            mine = [r for r in rows if not keys or r["k"] == k]
            ties, above, want = Counter(r["at"] for r in mine if r["at"] is not None), 0, {None: None}
            for v in sorted(ties, reverse=True):
                want[v] = above + (ties[v] + 1) / 2
                above += ties[v]
            assert all(got[r["id"]] == want[r["at"]] for r in mine)
        # One key or nearly so, several tasks, and no value in two of them.
        tasks = dealt[-1].groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
        sizes = [r["n"] for r in tasks.collect()]
        assert len(sizes) > 4 and max(sizes) < sum(sizes) / 3
        assert dealt[-1].groupBy(*keys, "at").agg(F.count_distinct("_range").alias("n")).where("n > 1").count() == 0


def test_prefix_sums_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "k string, at int, v int")
    assert ranges.prefix_sums(df, ["k"], "at", {"s": "v"}).collect() == []
    assert ranges.average_ranks_of_rows(df, "at").collect() == []


def test_a_ring_longer_than_a_task(spark, monkeypatch):
    dealt = []
    keep = geo.cut
    monkeypatch.setattr(geo, "cut", lambda d: dealt.append(keep(d)) or dealt[-1])
    i = F.col("id")
    long = spark.range(5000).select(F.lit("long").alias("region"), F.lit(1).alias("ring"), (i * 3).alias("idx"), F.cos(i / 800).alias("x"), F.sin(i / 800).alias("y"))
    short = spark.range(40).select(
        F.concat(F.lit("s"), (i % 4).cast("string")).alias("region"), F.floor(i / 4).cast("int").alias("ring"), (i % 4).alias("idx"), (i * i % 7).cast("double").alias("x"), (i % 5).cast("double").alias("y")
    )
    single = spark.createDataFrame([("one", 1, 1, 2.0, 3.0)], "region string, ring int, idx long, x double, y double")
    vertices = long.unionByName(short).unionByName(single)
    want = Counter(tuple(r) for r in geo.ring_edges(vertices).collect())
    assert Counter(tuple(r) for r in geo.split_ring_edges(vertices, parts=7).collect()) == want
    sizes = [r["count"] for r in dealt[0].where("region = 'long'").groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 5000 / 3
    a, b = ({r.region: r for r in geo.polygon_centroids(vertices, split=s).collect()} for s in (False, True))
    assert a.keys() == b.keys() and all(abs(a[k].area - b[k].area) < 1e-6 for k in a)


def test_earliest_doses_without_a_window(spark):
    i = F.col("id")
    # One person holds a third of all records, on very many dates.
    df = spark.range(6000).select(
        F.when(i % 3 == 0, F.lit(1)).otherwise(i % 500 + 2).alias("person_id"),
        F.when(i % 2 == 0, "1ra").otherwise("2da").alias("dose_name"),
        F.lit("P1").alias("province"),
        F.lit("0-2").alias("age_group"),
        F.date_add(F.lit("2000-01-01").cast("date"), ((i * 37) % 4000).cast("int")).alias("dose_date"),
    )
    out = coverage.earliest_doses(df)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    first, rows = {}, df.collect()
    for r in rows:
        k = r.person_id, r.dose_name
        first[k] = min(first.get(k, r.dose_date), r.dose_date)
    want = Counter((r.dose_name, r.dose_date) for r in rows if r.dose_date == first[r.person_id, r.dose_name])
    assert {(r.dose_name, r.dose_date): r.n for r in out.collect()} == want
