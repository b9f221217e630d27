import random

import pytest

from epifold.llm.pieces import CharacterMap, Model, decode, encode
from epifold.llm.q_pieces import model_path, round_trip

spm = pytest.importorskip("sentencepiece")
BITS = [" ", "  ", "▁", "a", "the", "\n", "\t", "é", "中", "🙂", "<s>", "<0x0A>", "́", "Ω", "ing", " s", "0", "\x00", "‍", "  \n", "x" * 70]


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def model():
    with open(model_path(), "rb") as file:
        return Model(file.read())


def test_ids_spans_and_texts_match_the_library(library, model):
    random.seed(1)
    for _ in range(1500):
        text = "".join(random.choice(BITS) for _ in range(random.randint(0, 25)))
        ids, starts, stops = model.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(starts, stops)) == raw
        odd = [random.randrange(32000) if random.random() < 0.7 else random.randrange(260) for _ in range(random.randint(0, 8))]
        assert model.decode(odd) == library.decode(odd)


def test_whole_texts_and_odd_rows(frame, library):
    rows = [(1, None), (2, ""), (3, "a  b"), (3, "a  b"), (None, "né\n"), (4, "word " * 30_000), (5, "x" * 50_000)]
    encoded = encode(frame(rows), model_path())
    assert {"doc_id", "lang", "score", "ids", "starts", "stops"} <= set(encoded.columns)
    got = decode(encoded.select("doc_id", "text", "ids"), model_path()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.decoded == library.decode(r.ids)


def test_empty_table(frame):
    assert round_trip(frame([]), model_path()).collect() == []


def test_longest_prefix_of_a_compiled_map():
    normaliser = spm.SentencePieceNormalizer(rule_name="nfkc")
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(normaliser.serialized_model_proto())
    own = Model.__new__(Model)
    own.map, own.prefix, own.squeeze = CharacterMap(proto.normalizer_spec.precompiled_charsmap), False, False
    for text in ("ﬁx ①②", "é", "Ａｂｃ", "ㅎㅏㄴ", "½ ㎏", "plain", "가"):
        chars, starts, stops = own.normalise(text)
        assert "".join(chars).replace("▁", " ") == normaliser.normalize(text).replace("▁", " ").lstrip()
        raw = text.encode()
        assert all(0 <= a < b <= len(raw) for a, b in zip(starts, stops))
        assert starts == sorted(starts) and stops == sorted(stops)
        covered = {k for a, b in zip(starts, stops) for k in range(a, b)}
        assert covered == set(range(len(raw)))


def mapped(path, rule, squeeze):
    """The model file with the compiled character map of a rule in place of its empty one."""
    from sentencepiece import sentencepiece_model_pb2

    proto, rules = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    rules.ParseFromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    return proto.SerializeToString()


MAPPED = [*BITS, "ﬁ", "①", "Ａｂｃ", "ㅎㅏㄴ", "½", "㎏", "가", "é", "é", "ñ̃", "　", " ", "ﷺ", "™", "Ⅷ", "​", "﻿", "ｶﾞ", "ẛ̣"]


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf"])
def test_a_model_with_a_character_map_matches_the_library(rule, squeeze):
    content = mapped(model_path(), rule, squeeze)
    own, library = Model(content), spm.SentencePieceProcessor(model_proto=content)
    assert len(own.map.units) and not own.plain
    random.seed(rule)
    for _ in range(600):
        text = "".join(random.choice(MAPPED) for _ in range(random.randint(0, 25)))
        ids, starts, stops = own.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), repr(text)
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())
        raw = text.encode()
        assert all(0 <= a <= b <= len(raw) for a, b in zip(starts, stops))
        assert list(starts) == sorted(starts)
        # No byte is lost but blanks and signs that the map leaves out.
        covered = {k for a, b in zip(starts, stops) for k in range(a, b)}
        lost = bytes(raw[k] for k in range(len(raw)) if k not in covered).decode()
        assert not library.normalize(lost).replace("▁", "").strip() or squeeze and not lost.strip()


def test_whole_texts_with_a_character_map(frame, tmp_path):
    path = tmp_path / "mapped.model"
    path.write_bytes(mapped(model_path(), "nmt_nfkc", True))
    library = spm.SentencePieceProcessor(model_file=str(path))
    rows = [(1, None), (2, ""), (3, "ﬁne  ①"), (4, "Ａ½ ㎏ " * 5000), (None, " é ")]
    encoded = encode(frame(rows), str(path))
    for r in decode(encoded.select("doc_id", "text", "ids"), str(path)).collect():
        assert r.ids == library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.decoded == library.decode(r.ids)
