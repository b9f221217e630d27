import numpy as np

from epifold.llm import toxicity

RARE = "zyxrare"


def test_rare_pure_words_are_kept_beside_many_common_ones(spark, frame):
    # The clean words have more features than 65,536, each in more confirmed documents than the rare word.
    common = " ".join(f"{k:05x}" for k in range(0, 80_000, 2))
    bad = range(60)
    docs = frame([(i, common + (f" {RARE}" if i % 2 else ""), "en", "s", 1) for i in bad] + [(i, common, "en", "s", 1) for i in range(60, 180)])
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i in range(180)], "doc_id long, quality int, toxic int")
    hashes, _, _ = toxicity.train(docs, labels)
    raw = RARE.encode()
    wanted = toxicity.features_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1]
    assert set(wanted.tolist()) == set(hashes.tolist())
