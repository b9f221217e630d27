from collections import Counter

import brute
import numpy as np

from epifold.llm import quality


def counts(text):
    text = text or ""
    w = brute.words(text)
    lines = [x for x in text.split("\n") if brute.words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(frame):
    rng = np.random.default_rng(4)

    def plain(n):
        return "\n".join(" ".join(f"wörd{k}" for k in rng.integers(0, 5000, 8)) for _ in range(n))

    rows = [(i, plain(int(rng.integers(3, 30))), "en", f"s{i % 2}", 1) for i in range(500)]
    rows += [(600, None, "en", "s0"), (601, "", None, None), (602, "a b\n\na b\n \na b ", "en", "s0"), (603, "#*$%&|<> " * 20, "en", "s0")]
    rows += [(604, "\n".join(["same line of text here"] * 30), "en", "s0"), (605, plain(6) + " &&&" * 40, "en", "s1"), (606, plain(20_000), None, "s1")]
    rows += [(607, "x" * 3000 + plain(4), "en", "s1"), (7, "one two three four five " * 2), (None, "\x0b\x0c\r\t")]
    got = {r.doc_id: r for r in quality.judge(frame(rows)).collect() if r.doc_id != 7}
    for r in rows:
        if r[0] != 7:
            g = got[r[0]]
            assert tuple(g[c] for c in quality.COUNTS) == counts(r[1]), r[0]
            assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words)
    assert all(got[i].kept for i in range(500) if i != 7)
    assert not any(got[i].kept for i in (600, 601, 602, 603, 604, 605, 607, None))


def test_buckets_keep_one_part_in_steps(spark):
    from pyspark.sql import functions as F

    values = [0, 1, 31, 63, 64, 65, 127, 128, 1000, 10**9]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b")).collect()
    for r in got:
        assert r.b <= r.v and (r.v - r.b) * quality.STEPS <= r.v and (r.b == r.v or r.v >= 64)


def test_bounds_follow_the_tails_of_a_group(frame):
    """Three sources: short texts with few signs, long ones without any, and many signs as a rule."""
    rng = np.random.default_rng(8)

    def text(n, signs):
        w = [f"w{k}" for k in rng.integers(0, 5000, n)]
        for k in rng.integers(0, n, signs):
            w[k] += "&"
        return " ".join(w)

    rows = [(i, text(40, int(rng.integers(0, 3) == 0)), "en", "short", 1) for i in range(400)]
    rows += [(1000 + i, text(400, 0), "en", "long", 1) for i in range(400)]
    rows += [(2000 + i, text(100, int(rng.integers(5, 40))), "en", "signs", 1) for i in range(400)]
    # As many signs per word as the third source has.
    rows += [(9000, text(400, 120), "en", "long"), (9001, text(40, 40), "en", "short"), (9002, text(100, 39), "en", "signs")]
    docs = frame(rows)
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert [kept[i] for i in (9000, 9001, 9002)] == [False, False, True]
    assert all(kept[r[0]] for r in rows if r[0] < 9000)
    by_source = {r.source: r for r in quality.rejections(docs).collect()}
    assert len({by_source[s].high_symbol_share for s in ("short", "long", "signs")}) == 3
    assert [by_source[s].symbol_share for s in ("short", "long", "signs")] == [1, 1, 0]
    assert {s: (r.n, r.base_failed) for s, r in by_source.items()} == {"short": (401, 0), "long": (401, 0), "signs": (401, 0)}


def test_patterned_lines_are_told_apart(frame):
    from test_minhash import opposites

    a, b = opposites(2048)
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{a}"), (3, " ".join([a, "x", "y", "z", "v", b, "x", "y", "z", "v"]))]
    got = {r.doc_id: tuple(r[c] for c in quality.COUNTS) for r in quality.judge(frame(rows)).collect()}
    assert got == {i: counts(t) for i, t in rows}
    assert got[1][3] == 0 and got[2][3] == 1 and got[3][4] == 0


def test_empty_table(frame):
    assert quality.judge(frame([])).collect() == []
