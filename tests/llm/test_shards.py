import numpy as np
import pytest

from epifold.llm.shards import permute, read_shards, write_shards


def pieces(rows, length):
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        out += [(i, k, raw[a : a + length]) for k, a in enumerate(range(0, len(raw), length))]
    return out


@pytest.mark.parametrize("total", [1, 2, 3, 10, 97, 1024, 5000])
def test_slots_are_a_permutation(total):
    slots = permute(np.arange(total), total)
    assert sorted(slots.tolist()) == list(range(total))
    if total > 50:
        assert abs(np.corrcoef(slots, np.arange(total))[0, 1]) < 0.4
        assert (permute(np.arange(total), total, key=1) != slots).mean() > 0.9
    assert sorted(permute(np.arange(total), total, key=2**63 + 5).tolist()) == list(range(total))


def test_shards_hold_every_sequence_and_resume(spark, frame, tmp_path):
    rows = [(i, "line\n\té" * (i % 40)) for i in range(300)] + [(900, None), (901, ""), (None, "no id"), (902, "x" * 50_000), (7, "twin"), (7, "twin"), (-5, "minus")]
    docs = frame(rows, 4)
    source = str(tmp_path / "docs")
    docs.write.parquet(source)
    path = str(tmp_path / "shards")
    total = write_shards(spark.read.parquet(source), path, length=64, rows=100)
    want = pieces([r[:2] for r in rows], 64)
    assert total == len(want)
    got = read_shards(spark, path, length=64, rows=100).collect()
    assert sorted(r.slot for r in got) == list(range(total))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, r.part, bytes(r.tokens)) for r in got), key=key) == sorted(want, key=key)
    late = read_shards(spark, path, start=total - 130, length=64, rows=100).collect()
    assert sorted(map(tuple, late)) == sorted(tuple(r) for r in got if r.slot >= total - 130)
    # The files before are not opened: a resumed read works without the first one.
    resumed = read_shards(spark, path, start=total - 130, length=64, rows=100)
    first = next(p for p in (tmp_path / "shards").iterdir() if p.name.startswith("part-00000-"))
    held = first.read_bytes()
    first.write_bytes(b"")
    first.chmod(0)
    assert sorted(map(tuple, resumed.collect())) == sorted(tuple(r) for r in got if r.slot >= total - 130)
    assert len(resumed.inputFiles()) == -(-total // 100) - (total - 130) // 100
    first.chmod(0o644)
    first.write_bytes(held)
    assert read_shards(spark, path, start=10 * total, length=64, rows=100).collect() == []
    # A record lies where its slot says.
    files = sorted(p for p in (tmp_path / "shards").iterdir() if p.name.startswith("part-"))
    assert all(f.stat().st_size == 81 * min(100, total - 100 * k) for k, f in enumerate(files))


def test_empty_table(spark, frame, tmp_path):
    path = str(tmp_path / "none")
    assert write_shards(frame([]), path) == 0
    assert read_shards(spark, path).collect() == []
