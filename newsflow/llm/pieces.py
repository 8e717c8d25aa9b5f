"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it came from.

The text is normalised here: at each place the longest prefix that the model's compiled character map knows is replaced,
and every normalised byte remembers the original byte its prefix began at. The library then segments the normalised text
with normalisation switched off in a copy of the model, and the pieces' byte lengths, carried through the alignment,
give the original spans.

Defined results: a null text counts as empty, and an empty text has no pieces; repeated rows are encoded one by one; very long texts
are encoded whole; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes, bytes]]:
    """Field number, wire type, value and raw bytes of each field of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        begin = i
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, i = data[i : i + size], i + size
        yield key >> 3, kind, value, data[begin:i]


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 prefixes, and the replacements it points to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]
        self.firsts = frozenset(b for b in range(1, 256) if self.units and self._child(self._base(0), b) is not None)

    def _base(self, at: int) -> int:
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _child(self, base: int, label: int) -> int | None:
        at = base ^ label
        return at if at < len(self.units) and (self.units[at] & 0x800000FF) == label else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes consumed and their replacement, for the longest known prefix of text[at:]."""
        best, base, i = None, self._base(0), at
        while i < len(text) and text[i] and (node := self._child(base, text[i])) is not None:
            base, i = self._base(node), i + 1
            if self.units[node] >> 8 & 1:
                start = self.units[base] & 0x7FFFFFFF
                best = i - at, self.texts[start : self.texts.index(b"\0", start)]
        return best


class Model:
    """A SentencePiece model split into its normaliser, here, and its segmentation, in the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = self.own.serialized_model_proto()
        spec, rest, lengths = {}, [], []
        for number, _, value, raw in _fields(proto):
            if number == 3:
                spec = {n: v for n, _, v, _ in _fields(value)}
            else:
                rest.append(raw)
            if number == 1:
                piece = {n: v for n, _, v, _ in _fields(value)}
                if piece.get(3, 1) == 4:
                    raise ValueError("models with user-defined symbols are not supported")
                lengths.append(1 if piece.get(3) == 6 else len(piece[1]))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        self.lengths = np.array(lengths)
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"  # no prefix, no squeezing, no escaping
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=b"".join([*rest, b"\x1a" + bytes([len(plain)]) + plain]))

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the place in the original bytes."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int32)
        if not self.map.units and not self.squeeze and self.escape:
            own = np.frombuffer(raw, np.uint8)
            starts = np.maximum.accumulate(np.where((own & 0xC0) != 0x80, np.arange(len(raw), dtype=np.int32), 0))
            places = np.repeat(starts, np.where(own == 32, 3, 1))
            head = [np.zeros(3 * self.prefix, np.int32)]
            return SPACE * self.prefix + text.replace(" ", SPACE), np.concatenate([*head, places, [len(raw)]]).astype(np.int32)
        return self._walk(raw)

    def _walk(self, raw: bytes) -> tuple[str, np.ndarray]:
        parts, i = [], 0  # (original place, normalised bytes)
        while i < len(raw):
            if raw[i] in self.map.firsts and (hit := self.map.longest(raw, i)):
                n, new = hit
            else:
                n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                new = raw[i : i + n]
            parts.append((i, new))
            i += n
        end = len(raw)
        if self.squeeze:
            begin = next((k for k, (_, new) in enumerate(parts) if new != b" "), len(parts))
            parts = parts[begin:]
            if not parts:
                return "", np.array([end], np.int32)
        space = SPACE.encode() if self.escape else b" "
        out, places, after_space = [], [], self.squeeze
        if self.prefix:
            out.append(space)
            places += [parts[0][0]] * len(space)
        for at, new in parts:
            if self.squeeze and after_space:
                new = new.lstrip(b" ")
            if new:
                shown = new.replace(b" ", space)
                out.append(shown)
                places += [at] * len(shown)
                after_space = new.endswith(b" ")
        joined = b"".join(out)
        if self.squeeze:
            length = len(joined)
            while joined.endswith(space, 0, length):
                length -= len(space)
            if length < len(joined):
                joined, end = joined[:length], places[length]
        return joined.decode(), np.array([*places[: len(joined)], end], np.int32)

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """Ids and the begins and ends of their pieces in the original UTF-8 bytes."""
        normal = [self.normalise(t) for t in texts]
        out = []
        for ids, (shown, places) in zip(self.bare.encode([n for n, _ in normal], num_threads=1), normal, strict=True):
            ends = np.cumsum(self.lengths[ids]) if ids else np.zeros(0, np.int64)
            if len(places) - 1 != (ends[-1] if ids else 0):
                # unknown pieces: the library knows how much of the text each covers
                ends = np.cumsum([len(p.surface.encode()) for p in self.bare.encode(shown, out_type="immutable_proto").pieces])
            out.append((ids, places[np.concatenate([[0], ends[:-1]]).astype(np.int64)] if ids else ends, places[ends] if ids else ends))
        return out


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 64) -> DataFrame:
    """A row for each document: id_col, ids, begins, ends (UTF-8 byte spans of the pieces in the original text), decoded."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                got = own.encode([x or "" for x in part.column(1).to_pylist()])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]).astype(np.int32))
                flat = [pa.array(np.concatenate([np.asarray(g[k], np.int32) for g in got])) for k in range(3)]
                decoded = own.own.decode([g[0] for g in got], num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.ListArray.from_arrays(offsets, f) for f in flat], pa.array(decoded, pa.string())], ["id", "ids", "begins", "ends", "decoded"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string").withColumnRenamed("id", id_col)
