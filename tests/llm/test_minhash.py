import brute
import numpy as np
import pytest

from epifold.llm import minhash, words

RNG = np.random.default_rng(5)


def prose(n):
    return " ".join(f"w{k}" for k in RNG.integers(0, 400, n))


def edited(text, n):
    w = text.split(" ")
    for k in RNG.integers(0, len(w), n):
        w[k] = f"e{RNG.integers(0, 10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    base = [prose(60) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edited(base[i % 3], int(RNG.integers(1, 9)))) for i in range(90)]
    rows += [(300, base[0]), (301, base[0].upper() + "\n"), (302, base[0].replace(" ", "\t")), (5, base[1]), (5, base[1])]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one"), (404, "ONE"), (405, "one two"), (406, None), (407, "ÉÉ x"), (408, "éé x")]
    rows += [(None, base[0]), (None, base[0]), (None, None), (500, prose(20_000))]
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_all_pairs(frame, rows, size):
    got = minhash.near_duplicates(frame(rows), size, 80).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute.near_duplicates(rows, size, 80)


def test_empty_table(frame):
    assert minhash.near_duplicates(frame([])).collect() == []


def test_signatures_within_the_distance_share_a_key():
    base = RNG.integers(0, 2**16, (200, minhash.POSITIONS)).astype(np.uint16)
    other = base.copy()
    for row in other:
        at = RNG.choice(minhash.POSITIONS, minhash.DISTANCE, replace=False)
        row[at] ^= np.uint16(1)
    a, b = minhash.keys_of(base), minhash.keys_of(other)
    assert ((a == b).any(axis=1)).all()


def test_sketches_bound_the_difference():
    for _ in range(50):
        a = np.unique(RNG.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: RNG.integers(0, 300)], RNG.integers(0, 2**63, 60, dtype=np.uint64)]))
        x, y = (minhash.sketches_of(s, np.array([0, len(s)]))[0].view(np.uint64) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_signatures_estimate_the_similarity():
    a = np.sort(RNG.integers(0, 2**63, 1000, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:800], RNG.integers(0, 2**63, 200, dtype=np.uint64)]))
    x, y = (minhash.signatures_of(s, np.array([0, len(s)])) for s in (a, b))
    assert abs((x == y).mean() - 800 / 1200) < 0.16


def test_word_spans_and_hashes():
    texts = ["a bb  ccc", "", "bb\x0b a", "\t", "x" * 300_000 + " a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = words.offsets_of(np.array([len(t) for t in texts]))
    starts, ends, before = words.words_of(data, offsets)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == [w for t in texts for w in brute.words(t)]
    assert before.tolist() == [0, 3, 3, 5, 5, 7]
    hashed = words.hash_spans(data, starts, ends)
    assert len(set(hashed.tolist())) == len(set(found))
    assert all((hashed[i] == hashed[j]) == (found[i] == found[j]) for i in range(7) for j in range(7))


def opposites(n):
    """Two texts of n letters that a polynomial modulo a power of two does not tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_patterned_words_are_told_apart(frame):
    rows = []
    for n in (16, 64, 65, 128, 512, 1024, 4096):
        a, b = opposites(n)
        rows += [(10 * n + 1, a), (10 * n + 2, b), (10 * n + 3, f"x {a} x {b} x"), (10 * n + 4, f"x {b} x {a} x")]
        data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
        starts = np.array([0, n + 1, 2 * n + 2])
        one, two, three = words.hash_spans(data, starts, starts + n).tolist()
        assert one == three != two
    assert sorted((tuple(r) for r in minhash.near_duplicates(frame(rows), 2, 80).collect()), key=str) == brute.near_duplicates(rows, 2, 80)
