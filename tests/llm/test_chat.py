import hashlib
import random
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from epifold.llm.chat import CONTROL, windows
from epifold.llm.q_chat import PROBE, op10_chat, read_back

SCHEMA = "conv_id long, turn long, role string, text string, window string, idx string"
BITS = [*CONTROL, "\\", "<", "[", "/", "s>", "INST]", " a", "b\n", "é", "🙂", "$1", "\\Q", "\\E", " ", "$"]


def digests(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, v in turns.items():
        v.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in v)
        loss = "".join(x for _, r, x in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA).repartition(3)


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def plain_windows(rows, budget, history):
    """(conv_id, window): (formatted, repeated, masked texts) by walking each conversation."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        turns[c].append((t is not None, t or 0, r, hashlib.md5(x.encode()).hexdigest(), x))

    def written(r, x):
        broken = [re.sub(r"([<\[])(?=/?s>|/?INST\]|</?SYS>>)", r"\1\\", y.replace("\\", "\\\\")) for y in (r, x)]
        return f"<s>{broken[0]}[INST]{broken[1]}[/INST]</s>"

    out = {}
    for c, v in turns.items():
        v.sort()
        roles, texts = [x[2] for x in v], [x[4] for x in v]
        size = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) + 4 for x in texts]
        start = [sum(size[:k]) for k in range(len(v))]
        system = roles[0] == "system"
        for w in sorted({s // max(1, budget // 2) for s in start}):
            own = [k for k in range(len(v)) if start[k] // max(1, budget // 2) == w]
            room = min(history, budget - sum(size[k] for k in own) - (size[0] if system else 0))
            again = [k for k in range(own[0]) if start[own[0]] - start[k] <= room]
            if own[0] and roles[own[0]] == "assistant":
                again.append(own[0] - 1)
            if own[0] and system:
                again.append(0)
            again = sorted(set(again))
            out[c, w] = ("".join(written(roles[k], texts[k]) for k in again + own), len(again), [texts[k] for k in own if roles[k] == "assistant"])
    return out


@pytest.mark.parametrize(("budget", "history"), [(40, None), (81, 15), (512, None)])
def test_windows_equal_a_walk(spark, budget, history):
    random.seed(budget)
    rows = []
    for c in range(25):
        for t in range(random.randint(1, 30)):
            role = random.choice(["user", "assistant", "assistant"] + ["system"] * (t == 0))
            rows.append((c, t, role, "".join(random.choice(BITS) for _ in range(random.randint(0, 25)))))
    rows += [(70, t, ("user", "assistant")[t % 2], "long " * random.choice([3, 90, 700])) for t in range(30)] + [(None, None, "assistant", "x"), (None, 3, "user", "y")]
    rows += [(71, 1, "user", "same")] * 40 + [(71, 0, "system", "s " * 60), (71, 2, "assistant", "end")]
    got = windows(frame(spark, rows), budget, history).collect()
    found = {(r.conv_id, r.window): (r.formatted, r.repeated, [r.formatted[s.start : s.stop] for s in r.loss]) for r in got}
    want = plain_windows(rows, budget, budget if history is None else history)
    assert found.keys() == want.keys() and len(got) == len(want)
    for k, (formatted, repeated, masked) in want.items():
        assert found[k][:2] == (formatted, repeated)
        assert [re.sub(r"(?s)\\(.)", r"\1", x) for x in found[k][2]] == masked


def test_turns_and_targets_are_read_back(spark):
    random.seed(1)
    rows = []
    for c in range(40):
        for t in range(random.randint(1, 25)):
            role = random.choice(["user", "assistant", "assistant", "<s>x", ""] + ["system"] * (t == 0))
            rows.append((c, t, role, "".join(random.choice(BITS) for _ in range(random.randint(0, 20)))))
    rows += [(100, 0, None, None), (101, None, "user", "x"), (101, None, "user", "x"), (101, 0, "assistant", "y"), (None, 0, "user", "z")]
    rows += [(102, t, "assistant", "w " * 2000) for t in range(3)] + [(103, 0, "system", "only")]
    df = windows(frame(spark, rows), budget=40)
    assert read(read_back(df)) == digests(rows)
    assert df.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 5


def test_windows_keep_system_history_and_budget(spark):
    rows = [(1, t, "system" if t == 0 else ("user", "assistant")[t % 2], f"turn {t} " + "w " * (t % 5)) for t in range(60)]
    got = sorted(windows(frame(spark, rows), budget=80, history=20).collect(), key=lambda r: r.window)
    assert [r.window for r in got] == list(range(len(got))) and len(got) > 5
    assert all(r.formatted.startswith("<s>system[INST]turn 0") and r.tokens <= 80 for r in got)
    assert got[0].repeated == 0 and all(r.repeated >= 2 for r in got[1:])
    # Every assistant text is under the mask once.
    masked = [r.formatted[s.start : s.stop] for r in got for s in r.loss]
    assert masked == [x for _, _, role, x in rows if role == "assistant"]


def test_sample_conversations_and_probe(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    assert read(op10_chat(spark, sf_dir)) == digests(rows)


def test_empty_table(spark):
    assert read_back(windows(frame(spark, []))).collect() == []
