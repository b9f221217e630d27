import hashlib

import brute
import corpus_pipeline
import numpy as np
import pytest

from epifold.llm import catalog, toxicity
from epifold.llm.q_pieces import model_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, out[-1], SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(steps):
    assert all(df.columns == steps[0].columns for df in steps[:5])


def test_toxicity_drops_what_it_rejects(spark, steps):
    model = toxicity.train(steps[0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = {r.doc_id for r in toxicity.scored(steps[0], model).where("score < 0.7").collect()}
    assert sorted(rows(steps[1])) == sorted(r for r in rows(steps[0]) if r[0] in kept)


def test_one_document_of_each_group_stays(steps):
    kept = {i for i, _, _, k in brute.near_duplicates(rows(steps[1]), 5, 80) if k}
    assert sorted(rows(steps[2])) == sorted(r for r in rows(steps[1]) if r[0] in kept)


def test_long_repeats_go(steps):
    want = [(i, rest.decode("utf-8", "ignore")) for i, *_, rest in brute.without_repeats(rows(steps[2]), corpus_pipeline.PASSAGE_BYTES)]
    assert sorted(rows(steps[3])) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())


def test_mixture_comes_near_its_targets(steps):
    from test_mixing import expected_targets

    sizes, taken, longest = {}, {}, 0
    for r in steps[3].collect():
        n = len(brute.words(r.text))
        sizes[r.source], longest = sizes.get(r.source, 0) + n, max(longest, n)
    for r in steps[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in expected_targets(sizes).items())
    assert set(rows(steps[4])) <= set(rows(steps[3]))


def test_digests_of_pieces(steps):
    spm = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model_path())

    def digest(i, text):
        ids = spm.encode(text, add_bos=True, add_eos=True)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(spm.decode(ids).encode()).hexdigest()

    assert sorted(tuple(r)[:4] for r in steps[5].collect()) == sorted(digest(*r) for r in rows(steps[4]))


def test_stages_on_empty_and_odd_rows(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    folder = corpus_pipeline.scratch_path(spark, "odd")
    labels.write.parquet(f"{folder}/labels.parquet")
    odd = [(1, None), (2, ""), (None, "a b"), (None, None), (3, "a b c"), (3, "a b c"), (4, "x " * 30_000, None, None, None)]
    for given in ([], odd):
        docs = frame(given)
        for name, stage in corpus_pipeline.STAGES:
            path = f"{folder}/{name}-{len(given)}"
            stage(spark, docs, folder).write.parquet(path)
            columns, docs = docs.columns, spark.read.parquet(path)
            assert name == "pieces" or docs.columns == columns
        assert (docs.count() > 0) == bool(given)


def test_run_and_registration(spark):
    builds, sql = catalog.load()
    assert [next(n for n in builds if n.startswith(f"op{k}_")) for k in (1, 2, 4, 5, 6, 7, 8, 9, 10)]
    assert set(sql) <= set(builds)
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"]


def test_no_column_is_overwritten(spark, frame):
    """Columns with the names that the stages use for themselves come back as they were."""
    names = ["_toxicity", "__toxicity", "_print", "_id", "_number", "row", "id", "print", "number", "kept", "first", "times", "n", "draw", "copy", "k1", "_0"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "en", "s", 1, *(f"{n}{i}" for n in names)) for i in range(6)]
    # Two texts with one id, so that documents are numbered anew.
    rows.append((5, " ".join(f"another{k}" for k in range(40)), "en", "s", 1, *(f"{n}x" for n in names)))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    folder = corpus_pipeline.scratch_path(spark, "clash")
    kind = [(k, 1, int(k < 30)) for k in range(60)]
    spark.createDataFrame(kind, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = out.collect()
        assert got
        for r in got:
            mark = "x" if r.text.startswith("another") else r.doc_id
            assert [r[n] for n in names] == [f"{n}{mark}" for n in names]
