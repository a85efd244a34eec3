"""SentencePiece encoding with byte offsets, and decoding.

The normaliser is our own: it walks the text and at each place takes the longest prefix that the model's compiled
character map knows (a double-array trie with the replacements), records the source span of every normalised byte, and
then applies the model's white-space rules. The segmentation of normalised text into pieces is done by the library, from
a copy of the model whose own normaliser is switched off; a text is segmented in parts - a run of the space mark with
what follows it - which is exact because no piece of the vocabulary has the mark after another character. Pieces then
map back through the recorded alignment to spans of source bytes.

``decode`` turns ids back into text as the library's ``decode(ids)`` does.

Defined results: null text counts as empty; empty text gives the end id alone; repeated rows are kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import plain

MARK = "▁"
SLICE = 128
#: Parts that a task remembers, and the longest of them.
KEEP, LONG = 200_000, 64
#: Kinds of pieces, as the model's file numbers them (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) for each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else (4 if kind == 5 else 8, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _message(number: int, body: bytes) -> bytes:
    out, size = bytes([number << 3 | 2]), len(body)
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return out + bytes([size]) + body


class CharMap:
    """A compiled character map: 4 bytes with the size of a double-array trie, the trie, then zero-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.replacements = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest known prefix of ``data[at:]``."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)]
        return found


class Pieces:
    """A model: normaliser, segmentation and decoder."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        normaliser, kept, kinds, names = {}, b"", [], []
        for number, value in fields(model):
            if number == 3:
                normaliser = dict(fields(value))
            else:
                if number == 1:
                    piece = dict(fields(value))
                    names.append(piece[1].decode())
                    kinds.append(piece.get(3, NORMAL))
                kept += _message(number, value)
        self.map = CharMap(normaliser.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(normaliser.get(i, 1)) for i in (3, 4, 5))
        plainly = _message(3, _message(1, b"identity") + bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0]))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=kept + plainly)
        self.names, self.kinds = names, kinds
        crossing = any(MARK in x.lstrip(MARK) for x, k in zip(names, kinds, strict=True) if k in (NORMAL, USER_DEFINED))
        lines = "" if any("\n" in x for x in names) else "\n"
        self.parts = (lambda text: [text]) if crossing else re.compile(f"{MARK}+[^{MARK}{lines}]*|[^{MARK}{lines}]+" + "|\n" * bool(lines)).findall
        self.end = self.library.eos_id()
        self.bytes = {i: int(x[3:-1], 16) for i, (x, k) in enumerate(zip(names, kinds, strict=True)) if k == BYTE}
        #: The map is empty and spaces stay as they are: each byte is its own longest prefix, and spans follow from the spaces alone.
        self.direct = not self.map.units and not self.squeeze and self.escape
        self.sizes = np.array([1 if k == BYTE else self._size(x) for x, k in zip(names, kinds, strict=True)], dtype=np.int32)
        self.unknown = self.library.unk_id()
        self.out = [bytes([self.bytes[i]]) if k == BYTE else b"" if k == CONTROL else " \u2047 ".encode() if k == UNKNOWN else x.replace(MARK, " ").encode() for i, (x, k) in enumerate(zip(names, kinds, strict=True))]
        self.widths = np.array([len(x) for x in self.out], dtype=np.int64)
        self.segmented: dict[str, tuple[bytes, bytes, bytes]] = {}

    def _size(self, piece: str) -> int:
        """Bytes of a piece; in a direct model those of its source, where a mark is a space."""
        return len(piece.encode()) - (len(MARK.encode()) - 1) * piece.count(MARK) * self.direct

    def _segment(self, parts: list[str]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """For each normalised part its ids, how many bytes each takes (both as 32-bit integers), and what the ids stand for."""
        found = self.library.encode(parts, num_threads=1)
        flat = list(chain.from_iterable(found))
        ids = np.array(flat, dtype=np.int32)
        sizes = self.sizes[ids]
        ends = np.cumsum(list(map(len, found)), dtype=np.int64)
        out, stops = b"".join(map(self.out.__getitem__, flat)), np.concatenate([[0], np.cumsum(self.widths[ids])])[ends].tolist()
        if self.unknown in flat:
            for part, end, own in zip(parts, ends.tolist(), found, strict=True):
                if self.unknown in own:
                    pieces = self.library.encode(part, return_type="proto").pieces
                    sizes[end - len(own) : end] = [1 if x.id in self.bytes else self._size(x.surface) for x in pieces]
        ids, sizes, at, start = ids.tobytes(), sizes.tobytes(), 0, 0
        for end, stop in zip((4 * ends).tolist(), stops, strict=True):
            yield ids[at:end], sizes[at:end], out[start:stop]
            at, start = end, stop

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised UTF-8 text and, for each of its bytes and its end, the place in the source's bytes."""
        data = text.encode("utf-8", "replace")
        out, source, at = bytearray(), [], 0
        mark = MARK.encode() if self.escape else b" "
        was_space = self.squeeze

        def add(piece: bytes, place: int) -> None:
            out.extend(piece)
            unchanged = data.startswith(piece, place)
            source.extend(range(place, place + len(piece)) if unchanged else [place] * len(piece))

        chunks = []
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, data[at : at + size]
            chunks.append((at, hit[1]))
            at += hit[0]
        end = len(data)
        if self.squeeze:
            while chunks and chunks[-1][1].strip(b" ") == b"":
                end = chunks.pop()[0]
            while chunks and chunks[0][1].strip(b" ") == b"":
                chunks.pop(0)
        if chunks and self.dummy_prefix:
            add(mark, chunks[0][0])
        for place, piece in chunks:
            if self.squeeze:
                if was_space and piece.startswith(b" "):
                    piece = piece.lstrip(b" ")
                if piece:
                    was_space = piece.endswith(b" ")
            add(piece.replace(b" ", mark), place)
        source.append(end)
        return bytes(out), np.array(source, dtype=np.int64)

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """``normalise`` as text. Where the map is empty and spaces stay as they are, each byte is its own longest
        prefix, and the alignment follows from the spaces alone."""
        if not self.direct:
            normal, source = self.normalise(text)
            return normal.decode(), source
        data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        source = np.repeat(np.arange(len(data) + 1), np.append(np.where(data == 32, len(MARK.encode()), 1), 1))
        normal = text.replace(" ", MARK)
        if text and self.dummy_prefix:
            normal, source = MARK + normal, np.concatenate([np.zeros(len(MARK.encode()), dtype=source.dtype), source])
        return normal, source

    def _marked(self, text: str) -> np.ndarray:
        """For a direct model and a text that holds marks of its own: the place of each counted byte in the source's bytes."""
        sizes = [len(x.encode("utf-8", "replace")) for x in text]
        at = np.cumsum([0, *sizes])
        inner = chain.from_iterable((a,) if x == MARK else range(a, a + n) for x, a, n in zip(text, at.tolist(), sizes, strict=False))
        return np.array([*[0] * self.dummy_prefix, *inner, at[-1]], dtype=np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first source byte, end source byte) of the pieces, with the end id last."""
        return next(self.encode_all([text], False))[:3]

    def encode_all(self, texts: list[str], decoded: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str | None]]:
        """``encode`` of each text and ``decode`` of its ids. Parts that are not known yet are segmented in one call; what a
        part's ids stand for is kept with it. Parts stay until ``KEEP`` are known, long ones only for these texts."""
        if self.direct:
            normal = [(MARK * self.dummy_prefix + x.replace(" ", MARK) if x else "", self._marked(x) if MARK in x else None) for x in texts]
        else:
            normal = [(x.decode(), source) for x, source in map(self.normalise, texts)]
        cut = [self.parts(x) if x else [] for x, _ in normal]
        known = self.segmented
        if len(known) > KEEP:
            known.clear()
        new = list(set().union(*cut).difference(known))
        if new:
            known.update(zip(new, self._segment(new), strict=True))
        for text, (_, source), parts in zip(texts, normal, cut, strict=True):
            own, sizes, out = zip(*map(known.__getitem__, parts), strict=True) if parts else ((), (), ())
            yield self._spans(text, source, b"".join(own), b"".join(sizes), b"".join(out) if decoded else None)
        for part in new:
            if len(part) > LONG:
                del known[part]

    def _spans(self, text: str, source: np.ndarray | None, own: bytes, sizes: bytes, out: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, str | None]:
        n = len(own) // 4
        ids, starts, stops = (np.zeros(n + 1, dtype=np.int32) for _ in range(3))
        ids[:n], ids[n] = np.frombuffer(own, dtype=np.int32), self.end
        np.cumsum(np.frombuffer(sizes, dtype=np.int32), out=stops[:n])
        if source is not None:
            starts[:n] = source[np.concatenate([[0], stops[: n - 1]])] if n else 0
            stops[:n] = source[stops[:n]]
        else:
            stops[:n] -= self.dummy_prefix  # no byte of the source stands for the first mark
            starts[1:n] = stops[: n - 1] if n else 0
        starts[n] = stops[n] = len(text) if text.isascii() else len(text.encode("utf-8", "replace"))
        return ids, starts, stops, None if out is None else self._text(out, ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, the first space goes, control ids are silent, runs of byte ids are read as
        UTF-8 with U+FFFD for each byte that fits nowhere."""
        return self._text(b"".join(map(self.out.__getitem__, ids)), ids)

    def _text(self, data: bytes, ids: list[int] | np.ndarray) -> str:
        """The text of ids that stand for ``data``."""
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids if isinstance(ids, list) else ids.tolist())
        if text.startswith(" ") and self.dummy_prefix:
            first = next((i for i in ids if self.kinds[i] != CONTROL), None)
            if first is not None and self.kinds[first] in (NORMAL, USER_DEFINED, UNUSED):
                return text[1:]
        return text

    def _decode_broken(self, ids: list[int]) -> str:
        out, run, first = [], bytearray(), True

        def flush() -> None:
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()

        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                first = False
                continue
            flush()
            kind = self.kinds[i]
            if kind == CONTROL:
                continue
            piece = " ⁇ " if kind == UNKNOWN else self.names[i].replace(MARK, " ")
            if first and self.dummy_prefix and kind != UNKNOWN and piece.startswith(" "):
                piece = piece[1:]
            out.append(piece)
            first = False
        flush()
        return "".join(out)


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if lead < 0xF5 else 1
            try:
                out.append(data[at : at + size].decode())
                at += size
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids, first, end: the ids of a text's pieces, and for each its span of the source text's UTF-8 bytes. With
    ``decoded`` the text that the ids decode to comes along, made in the same pass. Batches leave in small slices, since
    a text has more bytes of ids and spans than of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = list(pieces.encode_all(part.column(1).to_pylist(), decoded))
                offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, np.concatenate([x[i] for x in found])) for i in range(3)]
                texts = [pa.array([x[3] for x in found], type=pa.string())] * decoded
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, *texts], names=["doc_id", "ids", "first", "end", *["decoded"] * decoded])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, first array<int>, end array<int>" + ", decoded string" * decoded
    return docs.select(F.col(id_col).alias("doc_id"), plain(text_col).alias("text")).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (of ``encode_pieces``) with the column decoded: the text of its ids."""

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        pieces = load(model)
        return pa.array([pieces.decode(x.as_py()) for x in ids], type=pa.string())

    return encoded.withColumn("decoded", run(F.col("ids")))
