import random

import numpy as np
import pytest

from epifold.llm import words
from epifold.llm.pieces import Model
from epifold.llm.q_pieces import model_path

spm = pytest.importorskip("sentencepiece")
BITS = [" ", "  ", "▁", "a", "the", "\n", "\t", "é", "中", "🙂", "<s>", "ing", " s", "0", "\x00", "Ω", "  \n", "x" * 70, "word" * 20]


def content(change=lambda proto: None):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path(), "rb") as file:
        proto.ParseFromString(file.read())
    change(proto)
    return proto.SerializeToString()


def block(model, texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    ids, bounds = model.encode_block(data, words.offsets_of(np.array([len(t) for t in texts])))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_blocks_match_the_library():
    random.seed(3)
    library, model = spm.SentencePieceProcessor(model_file=model_path()), Model(content())
    for bits in (BITS, [b for b in BITS if b != "▁"]):
        texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 25))) for _ in range(600)]
        want = [library.encode(t, add_bos=True, add_eos=True) if t else [] for t in texts]
        assert block(model, [t.encode() for t in texts]) == want
    assert block(model, []) == [] and block(model, [b"", b""]) == [[], []]


def test_bytes_that_are_no_text():
    model = Model(content())
    texts = [b"a b\xe2\x96", b"\x81 c", b"\xffx", b"fine", b"", b"\xc3", b"\xa9"]
    want = [np.frombuffer(model.encode_ids(t.decode("utf-8", "replace")), np.int32).tolist() if t else [] for t in texts]
    assert block(model, texts) == want


def test_equal_scores_and_models_without_merges():
    def equal(proto):
        for p in proto.pieces:
            p.score = -float(len(p.piece) % 2)

    def single(proto):
        kept = [p for p in proto.pieces if p.type != 1 or len(p.piece) == 1]
        del proto.pieces[:]
        proto.pieces.extend(kept)

    for change in (equal, single):
        model = Model(content(change))
        texts = [b"the there nothing", b"aaaaaaa aaaa\n bbb", "été où".encode()]
        assert block(model, texts) == [np.frombuffer(model.encode_ids(t.decode()), np.int32).tolist() for t in texts]


def test_parts_are_merged_together(monkeypatch):
    """Merging each new part by itself made Python take 647 CPU seconds a GB (CHECK_r03.txt)."""
    model, alone = Model(content()), []
    solve = model.merger.solve
    monkeypatch.setattr(model.merger, "solve", lambda part: alone.append(part) or solve(part))
    monkeypatch.setattr(model, "_merge_short", lambda part: pytest.fail("a short part was merged alone"))
    texts = [f"some {k} words of{k} each row\n".encode() for k in range(500)] + [b"y" * 65]
    assert len(block(model, texts)) == 501 and alone == [" " + "y" * 65]
