"""Sub-word pieces of a compiled model: encoding with source spans, decoding.

A text is normalised by the model's compiled character map, longest prefix
first, which keeps for every normalised character the bytes it came from. The
pieces are then merged in order of score, and each piece is projected back to a
span of bytes of the original text. Merges never cross a blank that no piece
holds inside, so a text falls into short parts whose pieces are remembered.

Defined results: a NULL text is encoded as an empty one, NULL ids are decoded as
none; empty tables give empty results. Other columns pass through, columns with
the names of the results are replaced.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epifold.llm import words
from epifold.llm.merges import PLACE_BITS, Merger

BLANK = "▁"
# Kinds of piece and of model in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
#: Parts whose pieces a worker remembers.
REMEMBERED = 100_000
#: Bytes of texts whose parts are merged together.
TOGETHER = 1 << 23
#: Characters up to which pairs are scanned instead of queued.
SHORT = 64


class CharacterMap:
    """The compiled map of strings to their normal form, a double-array trie."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist()
        self.forms = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and normal form of the longest mapped prefix of the text from there."""
        if not self.units:
            return None

        def jump(unit):
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node, best = jump(self.units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= jump(unit)
            if (unit >> 8) & 1:
                best = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.forms[best[1] : self.forms.index(b"\0", best[1])]


class Memory:
    """Pieces of parts of texts; those not used for long are forgotten."""

    def __init__(self, solve):
        self.solve = solve
        self.old: dict[str, bytes] = {}
        outer = self

        class Young(dict):
            def __missing__(self, part):
                hit = outer.old.get(part)
                if hit is None:
                    hit = outer.solve(part)
                self[part] = hit
                return hit

        self.young, self.kind = Young(), Young

    def join(self, parts: list[str]) -> bytes:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, self.kind()
        return b"".join(map(self.young.__getitem__, parts))


class Model:
    """Pieces, scores and normalisation rules read from the bytes of a model file."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(content)
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = [p.type for p in proto.pieces]
        if trainer.model_type != MERGES or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge models with normal, control and byte pieces are read")
        if trainer.treat_whitespace_as_suffix or not rules.escape_whitespaces:
            raise ValueError("blanks must be escaped and stand before words")
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.fallback = trainer.byte_fallback
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.ranks = {p: -self.scores[i] for p, i in self.ids.items()}
        self.worst = float("inf")
        self.unknown = kinds.index(UNKNOWN)
        self.begin, self.end = trainer.bos_id, trainer.eos_id
        self.first, self.last = (np.int32(i).tobytes() for i in (self.begin, self.end))
        bytes_ = [i for i, k in enumerate(kinds) if k == BYTE]
        self.byte_ids = {int(proto.pieces[i].piece[3:5], 16): i for i in bytes_}
        self.surface = [b""] * len(kinds)
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                self.surface[i] = p.piece.replace(BLANK, " ").encode()
            elif p.type == UNKNOWN:
                self.surface[i] = trainer.unk_surface.encode()
        for value, i in self.byte_ids.items():
            self.surface[i] = bytes([value])
        self.covers = np.array([len(x) for x in self.surface], np.int32)
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        inner = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        known = {c for p in self.ids for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in known and chr(c) != " ")
        # Without a piece that holds a blank after a letter, parts are independent.
        self.parts = None if inner else re.compile(f" *[^ {alone}]+| +" + (f"|[{alone}]" if alone else ""))
        self.plain = not self.map.units and not self.squeeze and self.parts is not None and self.fallback
        self.memory = Memory(self._part)
        # Blocks of texts are merged together where every text starts with a blank that is a piece.
        self.together = self.plain and self.prefix and BLANK in self.ids and len(self.byte_ids) == 256 and len(kinds) < 1 << (30 - PLACE_BITS)

    @cached_property
    def merger(self) -> Merger:
        return Merger(self, BLANK, self._part)

    def normalise(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """Characters, and the source bytes [start, stop) of each."""
        source = text.encode("utf-8", "surrogatepass")
        chars, starts, stops, at = [], [], [], 0
        # Blanks at the head of a form go if the form before ended with one; a written "▁" is no blank here.
        blank = self.squeeze
        while at < len(source):
            hit = self.map.longest(source, at)
            if hit is None:
                lead = source[at]
                length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                form = source[at : at + length]
            else:
                length, form = hit
            kept = form.decode("utf-8", "replace")
            if blank:
                kept = kept.lstrip(" ")
            if kept:
                blank = self.squeeze and kept.endswith(" ")
            for c in kept:
                chars.append(BLANK if c == " " else c)
                starts.append(at)
                stops.append(at + length)
            at += length
        while self.squeeze and chars and chars[-1] == BLANK:
            chars.pop(), starts.pop(), stops.pop()
        if self.prefix and chars:
            start = starts[0]
            chars, starts, stops = [BLANK, *chars], [start, *starts], [start, *stops]
        return chars, starts, stops

    def merge(self, chars: list[str]) -> list[int]:
        """Lengths, in characters, of the pieces: pairs are merged by score, then from the left."""
        if len(chars) <= SHORT:
            return [len(p) for p in self._merge_short(list(chars))]
        n = len(chars)
        part = list(chars)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left):
            if left >= 0 and (right := after[left]) < n:
                both = part[left] + part[right]
                if (i := self.ids.get(both)) is not None:
                    heapq.heappush(heap, (-self.scores[i], left, right, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if not part[left] or after[left] != right or part[left] + part[right] != both:
                continue
            part[left], part[right] = both, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [len(p) for p in part if p]

    def _merge_short(self, part: list[str]) -> list[str]:
        """The pieces of a few characters, by scanning the pairs; the list is used up."""
        rank, none = self.ranks.get, self.worst
        order = [rank(a + b, none) for a, b in zip(part, part[1:])]
        while order:
            best = min(order)
            if best == none:
                break
            i = order.index(best)
            part[i] += part.pop(i + 1)
            order.pop(i)
            if i:
                order[i - 1] = rank(part[i - 1] + part[i], none)
            if i < len(order):
                order[i] = rank(part[i] + part[i + 1], none)
        return part

    def encode_chars(self, chars: list[str], starts: list[int], stops: list[int]) -> tuple[list[int], list[int], list[int]]:
        ids, first, last, at = [], [], [], 0
        for size in self.merge(chars):
            piece = "".join(chars[at : at + size])
            a, b = starts[at], stops[at + size - 1]
            known = self.ids.get(piece)
            if known is not None:
                ids.append(known)
                first.append(a)
                last.append(b)
            elif self.fallback:
                raw = piece.encode("utf-8", "surrogatepass")
                for k, value in enumerate(raw):
                    ids.append(self.byte_ids[value])
                    # Bytes of an unmapped character stand for themselves.
                    own = b - a == len(raw)
                    first.append(a + k if own else a)
                    last.append(a + k + 1 if own else b)
            elif ids and ids[-1] == self.unknown and last[-1] == a:
                last[-1] = b
            else:
                ids.append(self.unknown)
                first.append(a)
                last.append(b)
            at += size
        return ids, first, last

    def _part(self, part: str) -> bytes:
        """Ids of a part as 32-bit numbers."""
        chars = list(part.replace(" ", BLANK))
        if len(chars) <= SHORT:
            pieces = self._merge_short(chars)
        else:
            stops = list(accumulate(self.merge(chars)))
            joined = "".join(chars)
            pieces = [joined[a:b] for a, b in zip([0, *stops[:-1]], stops)]
        out = list(map(self.ids.get, pieces))
        if None in out:
            out = [x for p, i in zip(pieces, out) for x in ([i] if i is not None else [self.byte_ids[b] for b in p.encode()])]
        return array("i", out).tobytes()

    def _remembered(self, text: str) -> tuple[list[str], bytes]:
        """The parts of a text and their ids as 32-bit numbers."""
        parts = self.parts.findall(text)
        if parts and self.prefix:
            parts[0] = " " + parts[0]
        return parts, self.memory.join(parts)

    def encode_ids(self, text: str) -> bytes:
        """The ids of :meth:`encode` alone, as 32-bit numbers."""
        if not self.plain or BLANK in text:
            return self.encode(text)[0].tobytes()
        return b"".join((self.first, self._remembered(text)[1], self.last))

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of :meth:`encode_ids` of texts that lie back to back, and the ids before each; an empty text has none."""
        sizes = np.diff(offsets)
        alone = self._alone(data, offsets) & (sizes > 0)
        together = ~alone & (sizes > 0)
        counts = np.zeros(len(sizes), np.int64)
        flat = np.zeros(0, np.int32)
        if together.any():
            some = data[np.repeat(together, sizes)] if alone.any() else data
            ids, before = self.merger.block(some, words.offsets_of(sizes[together]))
            counts[together] = np.diff(before) + 2
            edges = words.offsets_of(counts[together])
            flat = np.empty(edges[-1], np.int32)
            inner = np.ones(len(flat), bool)
            inner[edges[:-1]] = inner[edges[1:] - 1] = False
            flat[inner] = ids
            flat[edges[:-1]], flat[edges[1:] - 1] = self.begin, self.end
        rows = np.flatnonzero(alone)
        if not len(rows):
            return flat, words.offsets_of(counts)
        at = words.offsets_of(counts)[rows]
        own = [np.frombuffer(self.encode_ids(data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")), np.int32) for r in rows.tolist()]
        counts[rows] = [len(ids) for ids in own]
        return np.insert(flat, np.repeat(at, counts[rows]), np.concatenate(own)), words.offsets_of(counts)

    def _alone(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts that are not encoded together with others: those with a written "▁" or bytes that are no text."""
        if not self.together:
            return np.ones(len(offsets) - 1, bool)
        out = np.zeros(len(offsets) - 1, bool)
        raw, blank = data.tobytes(), BLANK.encode()
        at = raw.find(blank)
        while at >= 0:
            row = np.searchsorted(offsets, at, "right") - 1
            out[row] = True
            at = raw.find(blank, int(offsets[row + 1]))
        starts = offsets[:-1][np.diff(offsets) > 0]
        if not (_is_text(raw) and ((data[starts] & 0xC0) != 0x80).all()):
            out |= [not _is_text(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and last byte of each piece, with the begin and end ids."""
        if not self.plain or BLANK in text:
            chars, starts, stops = self.normalise(text)
            ids, first, last = self.encode_chars(chars, starts, stops)
            size = len(text.encode("utf-8", "surrogatepass"))
            return (
                np.array([self.begin, *ids, self.end], np.int32),
                np.array([0, *first, size], np.int32),
                np.array([0, *last, size], np.int32),
            )
        parts, found = self._remembered(text)
        found = np.frombuffer(found, np.int32)
        ids = np.empty(len(found) + 2, np.int32)
        ids[0], ids[1:-1], ids[-1] = self.begin, found, self.end
        # A piece covers the bytes of its surface, the added blank none.
        last = np.zeros(len(ids), np.int32)
        np.cumsum(self.covers[found], out=last[1:-1])
        if parts and self.prefix:
            last[1:-1] -= 1
        last[-1] = last[-2]
        first = np.zeros(len(ids), np.int32)
        first[1:] = last[:-1]
        return ids, first, last

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        lead, skip = 0, None
        if self.prefix or self.squeeze:
            # One blank, or every one where blanks are squeezed, goes from the start.
            for k, i in enumerate(ids):
                if i in self.control:
                    continue
                surface = self.surface[i]
                if i == self.unknown or i in self._byte_set or not surface.startswith(b" "):
                    break
                skip, lead = k, 1
                if not self.squeeze or surface != b" ":
                    break
        get = self.surface.__getitem__
        if skip is None:
            raw = b"".join(map(get, ids))
        elif self.squeeze:
            raw = get(ids[skip])[lead:] + b"".join(map(get, ids[skip + 1 :]))
        else:
            raw = b"".join(map(get, ids[:skip])) + get(ids[skip])[lead:] + b"".join(map(get, ids[skip + 1 :]))
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return "".join(_lenient(raw))

    @property
    def _byte_set(self) -> set[int]:
        if not hasattr(self, "_bytes"):
            self._bytes = set(self.byte_ids.values())
        return self._bytes


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _lenient(raw: bytes) -> Iterator[str]:
    """Characters of bytes; every byte that starts none is a replacement sign."""
    at = 0
    while at < len(raw):
        lead = raw[at]
        length = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        try:
            yield raw[at : at + length].decode("utf-8") or "�"
            at += max(1, length)
        except UnicodeDecodeError:
            yield "�"
            at += 1


_models: dict[int, Model] = {}


def _model(shared) -> Model:
    """The model of a broadcast file, read once per worker."""
    content = shared.value
    key = hash(content)
    if key not in _models:
        _models.clear()
        _models[key] = Model(content)
    return _models[key]


RESULTS = ("ids", "starts", "stops")


def _share(df: DataFrame, path: str):
    """The model file's bytes for the tasks; its size does not depend on the data."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, packed: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` and the byte spans ``starts`` and ``stops`` of its ``text``.

    ``packed`` ids are bytes, four for each id with the lowest first. With
    ``decoded`` the same task decodes them again, as :func:`decode` does.
    """
    shared = _share(docs, path)
    results = [*RESULTS, *(["decoded"] if decoded else [])]
    keep = [c for c in docs.columns if c not in results]

    def run(batches):
        from epifold.llm.pieces import _model as load

        model = load(shared)
        for batch in batches:
            data, offsets = words.column(batch, "text")
            for i, j in words.blocks(offsets):
                out = [model.encode(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1])]
                bounds = words.offsets_of(np.array([len(ids) for ids, _, _ in out]))
                flat = [np.concatenate([o[k] for o in out]) for k in range(3)]
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in flat]
                if packed:
                    lists[0] = words.binary(flat[0].astype("<i4").view(np.uint8), bounds * 4)
                if decoded:
                    lists.append(pa.array([model.decode(ids.tolist()) for ids, _, _ in out], pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keep), *lists], [*keep, *results])

    numbers = T.ArrayType(T.IntegerType())
    fields = [docs.schema[c] for c in keep]
    fields += [T.StructField(c, T.BinaryType() if packed and c == "ids" else numbers) for c in RESULTS]
    schema = T.StructType([*fields, *([T.StructField("decoded", T.StringType())] if decoded else [])])
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def id_bytes(path: str) -> int:
    """Bytes that hold each id of a model and leave one value free: two or four."""
    with open(path, "rb") as file:
        return 2 if len(Model(file.read()).scores) < 1 << 16 else 4


def encode_ids(docs: DataFrame, path: str, width: int = 4) -> DataFrame:
    """(doc_id, ids): packed ids of ``width`` bytes each, the lowest first; a text without characters has none."""
    shared = _share(docs, path)

    def run(batches):
        from epifold.llm.pieces import _model as load

        model = load(shared)
        for batch in batches:
            for i, j, data, offsets in words.text_blocks(batch, "text", TOGETHER):
                ids, bounds = model.encode_block(data, offsets)
                flat = ids.astype(f"<u{width}").view(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), words.binary(flat, bounds * width)], ["doc_id", "ids"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the ``decoded`` text of its ``ids``, packed or not."""
    shared = _share(encoded, path)
    keep = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        from epifold.llm.pieces import _model as load

        model = load(shared)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                value = ids.as_buffer() if pa.types.is_binary(ids.type) else ids.values
                if value is None:
                    texts.append("")
                elif isinstance(value, pa.Buffer):
                    texts.append(model.decode(np.frombuffer(value, "<i4").tolist()))
                else:
                    texts.append(model.decode(value.to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(run, schema)
