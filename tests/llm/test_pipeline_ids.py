import corpus_pipeline


def words(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def test_texts_that_share_an_id_are_different_documents(spark, frame):
    a, b, c, d = map(words, "abcd")
    rows = [(7, a), (7, b), (8, a + " end"), (9, b + " end"), (10, c), (-11, d), (-11, d), (12, d + " end"), (13, None), (13, "short"), (None, a)]
    got = corpus_pipeline.drop_near_duplicates(spark, frame(rows), "").select("doc_id", "text").collect()
    want = [(7, a), (7, b), (10, c), (-11, d), (13, None), (13, "short"), (None, a)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
