"""SentencePiece encoding and decoding with byte offsets into the original text.

The model's compiled character map (a double-array trie followed by its
replacement strings) is read and applied here by longest prefix, recording for
every normalised byte where it came from.  The library segments the text; the
lengths of its pieces, laid along the normalised bytes, are projected through
that alignment to byte spans of the original.  If the pieces do not cover the
normalised text exactly, the encoding stops with an error.

Runs in Arrow batches of the scan's partitions, a few texts at a time: no
shuffle, and the memory is that of a batch and the ids of a few texts.

Cases: null counts as an empty text, whose ids are the begin and the end only;
texts are encoded whole at any length; repeated rows are encoded each; an empty
table gives an empty table.  The operators are column expressions, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.llm import common

MODEL = "piece_bpe_32k.model"
BLANK = "▁".encode()
#: Code points of text that are encoded in one call.
CHUNK = 200_000

_models: dict = {}


class CharMap:
    """Longest-prefix replacement by a compiled character map."""

    def __init__(self, blob: bytes):
        self.units, self.strings, self.starts = (), b"", np.zeros(256, bool)
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size:]
            root = self._offset(self.units[0])
            self.starts = np.array([c > 0 and (root ^ c) < len(self.units) and self.units[root ^ c] & 0x800000FF == c for c in range(256)])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes consumed and their replacement at ``at``; (0, b"") if no rule fits."""
        units, best, value = self.units, 0, 0
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return (best, self.strings[value:self.strings.index(b"\0", value)]) if best else (0, b"")

    def apply(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes, and for each the start in ``data`` of what it stands for."""
        raw = np.frombuffer(data, np.uint8)
        if not self.starts.any():
            return raw, np.arange(len(raw))
        out, origin, done = [], [], 0
        for at in np.flatnonzero(self.starts[raw]).tolist():
            if at < done:
                continue
            length, new = self.longest(data, at)
            if length:
                out += (raw[done:at], np.frombuffer(new, np.uint8))
                origin += (np.arange(done, at), np.full(len(new), at))
                done = at + length
        return np.concatenate([*out, raw[done:]]), np.concatenate([*origin, np.arange(done, len(raw))])


class Model:
    """A SentencePiece model with its normaliser laid open."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        with open(path, "rb") as f:
            blob = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.spec, self.map = proto.normalizer_spec, CharMap(proto.normalizer_spec.precompiled_charsmap)
        if proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in proto.pieces):
            raise ValueError("models with blanks as suffix or user-defined symbols are not supported")
        # bytes that a piece covers; control pieces none, a byte piece one
        self.unk = self.processor.unk_id()
        self.covers = np.array([{3: 0, 6: 1}.get(p.type, len(p.piece.encode())) for p in proto.pieces])

    def normalise(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes as the segmenter sees them, and the origin of each byte and of the end."""
        if not data:
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
        norm, origin = self.map.apply(data)
        if self.spec.remove_extra_whitespaces:
            blank = norm == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            norm, origin = norm[keep], origin[keep]
            if len(norm) and norm[-1] == 32:
                norm, origin = norm[:-1], origin[:-1]
        if self.spec.add_dummy_prefix and len(norm):
            norm, origin = np.concatenate([[np.uint8(32)], norm]), np.concatenate([origin[:1], origin])
        if self.spec.escape_whitespaces:
            blank = norm == 32
            wide = np.where(blank, 3, 1)
            starts = np.cumsum(wide) - wide
            origin = np.repeat(origin, wide)
            norm = np.repeat(norm, wide)
            for i, b in enumerate(BLANK):
                norm[starts[blank] + i] = b
        return norm, np.concatenate([origin, [len(data)]])

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans in ``text`` of the pieces; control pieces have empty ones."""
        norm, origin = self.normalise(text.encode())
        covers = self.covers[ids]
        if (ids == self.unk).any():
            covers = covers.copy()
            shown = self.processor.encode(text, out_type=str)
            covers[covers.nonzero()[0]] = [1 if p.startswith("<0x") and self.processor.is_byte(self.processor.piece_to_id(p)) else len(p.encode()) for p in shown]
        ends = np.cumsum(covers)
        if len(ends) and ends[-1] != len(norm):
            raise ValueError("the pieces do not cover the normalised text")
        return origin[ends - covers], origin[ends]

    def encode(self, texts: list[str], bos: bool = True, eos: bool = True) -> list[list[int]]:
        return self.processor.encode(texts, add_bos=bos, add_eos=eos, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids, num_threads=1)


def model(path: str | None = None) -> Model:
    path = path or common.tokenizer_file(MODEL)
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def chunks(texts: pa.Array):
    """Lists of texts of at most ``CHUNK`` code points, or one longer text; null is empty."""
    out, size = [], 0
    for t in texts:
        s = t.as_py() or ""
        if out and size + len(s) > CHUNK:
            yield out
            out, size = [], 0
        out.append(s)
        size += len(s)
    if out:
        yield out


def encode(text: Column, path: str | None = None, bos: bool = True, eos: bool = True) -> Column:
    """struct<ids, starts, ends>: piece ids with their byte spans in the text's UTF-8."""
    kind = pa.struct([(k, pa.list_(pa.int32())) for k in ("ids", "starts", "ends")])

    @F.arrow_udf("struct<ids:array<int>,starts:array<int>,ends:array<int>>")
    def run(texts: pa.Array) -> pa.Array:
        m, out = model(path), []
        for some in chunks(texts):
            for s, ids in zip(some, m.encode(some, bos, eos)):
                starts, ends = m.spans(s, np.array(ids, np.int64))
                out.append({"ids": ids, "starts": starts, "ends": ends})
        return pa.array(out, kind)

    return run(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of an array of ids; null gives null."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        m = model(path)
        return pa.array([None if x.as_py() is None else m.decode([x.as_py()])[0] for x in lists], pa.string())

    return run(ids)


def digests(text: Column, path: str | None = None) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256, spans_sha256> of a text encoded and decoded again.

    The digests are taken beside the segmenter, so ids and spans do not travel
    to the JVM.  ``spans_sha256`` is over all starts, then all ends, as 32-bit
    little-endian integers.
    """
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string())])

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,spans_sha256:string>")
    @common.batchwise
    def run(texts: pa.Array) -> pa.Array:
        m, out = model(path), []
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for some in chunks(texts):
            ids = m.encode(some)
            for s, x, back in zip(some, ids, m.decode(ids)):
                a = np.array(x, "<u4")
                starts, ends = m.spans(s, a)
                out.append((len(x), sha(a.tobytes()), sha(back.encode()), sha(np.concatenate([starts, ends]).astype("<u4").tobytes())))
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], fields=list(kind))

    return run(text)


def report(df, id_col: str = "doc_id", text_col: str = "text", path: str | None = None):
    """One row per document: number of ids and digests of ids, decoded text and spans."""
    done = df.select(F.col(id_col).alias("doc_id"), digests(F.col(text_col), path).alias("d"))
    return done.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256", "d.spans_sha256")
