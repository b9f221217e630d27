import hashlib

import brute
import numpy as np
from pyspark.sql import functions as F

from epifold.llm import catalog, suffix
from epifold.llm.bwt import repeated_starts
from epifold.sources.storage import Scratch

RNG = np.random.default_rng(3)
LETTERS = "abcdefghij klmnop"


def noise(n):
    return "".join(LETTERS[k] for k in RNG.integers(0, len(LETTERS), n))


def expected(rows, length):
    return [(i, n, gone, spans, hashlib.sha256(rest).hexdigest()) for i, n, gone, spans, rest in brute.without_repeats(rows, length)]


def test_transform_finds_all_repeats():
    for trial in range(150):
        letters, length = int(RNG.integers(1, 4)), int(RNG.integers(2, 12))
        texts = [bytes(RNG.integers(65, 65 + letters, RNG.integers(0, 50)).astype(np.uint8)) for _ in range(RNG.integers(1, 10))]
        if trial % 3 == 0 and len(texts) > 2:
            texts[1] = texts[0]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = repeated_starts(data, offsets, length)
        strings = [t[k : k + length] if k + length <= len(t) else None for t in texts for k in range(len(t))]
        assert found.tolist() == [s is not None and strings.count(s) > 1 for s in strings]


def test_spans_match_every_window(frame):
    passage = noise(150)
    rows = [(i, noise(int(RNG.integers(30, 90))) + passage + noise(int(RNG.integers(0, 60)))) for i in range(80)]
    rows += [(500, passage + passage), (501, None), (502, ""), (503, passage), (503, passage), (None, passage[:60]), (None, noise(90))]
    rows += [(504, "é" * 80), (505, "xé" * 80), (506, "short"), (507, noise(20_000)), (508, rows[7][1])]
    # So few classes per block that the hot anchor's windows are cut down to single ones.
    for many in (4, 2000):
        got = suffix.remove_repeats(frame(rows), length=40, gram=8, many=many).collect()
        assert sorted((tuple(r) for r in got), key=str) == expected(rows, 40)


def test_documents_keep_columns_and_lose_repeats(frame):
    passage = noise(100)
    rows = [(1, "a" + passage, "en", "s", 101), (2, passage + "é", None, None, None), (3, None), (4, "plain")]
    docs = frame(rows)
    got = suffix.without_repeats(docs, length=40, gram=8)
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.lang, r.k1) for r in got.collect()} == {
        1: ("a", "en", "x"), 2: ("é", None, "x"), 3: (None, None, "x"), 4: ("plain", None, "x")
    }


def test_windows_have_one_anchor_each():
    texts = [noise(500), "", noise(30), noise(41)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    row, start, count, place, _ = suffix.windows_of(data, offsets, 40, 8)
    covered = sorted((r, s + k) for r, s, c in zip(row.tolist(), start.tolist(), count.tolist()) for k in range(c))
    assert covered == [(r, s) for r, t in enumerate(texts) for s in range(len(t) - 39)]
    assert ((place >= start + count - 1) & (place + 8 <= start + 40)).all()


def test_empty_table(frame):
    assert suffix.remove_repeats(frame([])).collect() == []


def test_bytes_of_whole_repeats_are_not_moved(frame, monkeypatch):
    """Every fragment was cut out: pieces of 3.3 times the bytes of all texts lay between here, now of 0.03 times."""
    passage, held = noise(4_000), []
    rows = [(i, noise(10) + passage + noise(int(RNG.integers(0, 60)))) for i in range(30)]
    stored = Scratch.store

    def store(self, df, name, *more):
        out = stored(self, df, name, *more)
        if "piece" in out.columns:
            held.append(out.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(Scratch, "store", store)
    got = suffix.remove_repeats(frame(rows), length=40, gram=8).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, 40)
    assert held and sum(held) < 0.5 * sum(len(t) for _, t in rows)


def test_query_cuts_from_400_bytes_on(spark, frame, tmp_path):
    """The contract's length counts, not the words: 57 words in 399 bytes stay, 400 bytes go."""
    short, full = " ".join(f"w{k:05d}" for k in range(57)) + ".", noise(400)
    assert len(short) == 399
    # Other bytes stand on both sides, so that no repeat is longer than meant.
    rows = [(1, "a" + short + "b"), (2, "c" + short + "d"), (3, "e" + full + "f"), (4, "g" + full + "h"), (5, noise(900))]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in catalog.load()[0]["op8_suffix"](spark, str(tmp_path)).collect()}
    assert got == {1: (401, 0, 0), 2: (401, 0, 0), 3: (402, 400, 1), 4: (402, 400, 1), 5: (900, 0, 0)}
