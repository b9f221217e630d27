import numpy as np
from pyspark.sql import functions as F

from epifold.llm import language

TEXTS = {
    "de": "der die und nicht zu schön straße über machen können",
    "en": "the and with should that this have been their where",
    "el": "και το να είναι που για με από στο την",
}


def docs_of(frame, n=150):
    rng = np.random.default_rng(2)
    tags = sorted(TEXTS)
    rows = []
    for i in range(n):
        words = TEXTS[tags[i % 3]].split()
        rows.append((i, " ".join(words[k] for k in rng.integers(0, 10, 12)).title(), tags[i % 3], "s", 1))
    return rows


def test_held_out_texts_and_odd_rows(frame):
    rows = docs_of(frame) + [(900, None, "en"), (901, "", "de"), (902, "123 ?!", "en"), (903, "Und", None), (None, "the and", "de"), (5, "the the", "en"), (904, "the " * 100_000, None)]
    docs = frame(rows)
    got = language.predict(docs, *language.train(docs)).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    assert all(found[i].lang_pred == rows[i][2] for i in range(150) if i != 5)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (900, 901, 902))
    assert found[903].lang_pred == "de" and found[904].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_languages_teach_nothing(frame):
    docs = frame(docs_of(frame))
    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = language.train(docs), language.train(wrong)
    assert a[0] == b[0] == sorted(TEXTS) and np.array_equal(a[1], b[1])


def test_empty_tables_and_no_teachers(frame):
    docs = frame(docs_of(frame, 5))
    model = language.train(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("false"))
    assert model[0] == []
    assert {r.lang_pred for r in language.predict(docs, *model).collect()} == {"und"}
    assert language.predict(docs.where("false"), *model).collect() == []


def test_sample_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.predict(docs, *language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    out = [r.lang == r.lang_pred for r in got.where(language.held_out(F.col("doc_id"))).collect()]
    assert np.mean(out) > 0.98


def test_long_texts_add_up_from_their_parts(monkeypatch):
    raw = "\n".join(" ".join(TEXTS.values()) for _ in range(300)).encode()
    data, offsets, letters = np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), language.Letters()
    whole = language.profiles(letters, data, offsets)
    monkeypatch.setattr(language, "BLOCK", 1000)
    assert len(list(language._parts(data, offsets))) > 10
    assert np.array_equal(language.profiles(letters, data, offsets), whole)


def test_profiles_do_not_depend_on_the_block():
    texts = ["Ab cd, ef", "", "  x ", "ÄÖ ü"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    letters = language.Letters()
    whole = language.profiles(letters, np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, r in enumerate(raw):
        one = language.profiles(letters, np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.array_equal(one[0], whole[i])
