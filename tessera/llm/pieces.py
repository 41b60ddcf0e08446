"""SentencePiece encoding and decoding with source offsets.

Normalisation follows the model's compiled character map: at each position the longest prefix
found in its double-array trie is replaced, anything else is copied, and for every byte of the
result the source byte it came from is recorded. The normalised text is cut before each run of
word-start marks and around characters that no longer piece contains (no merge crosses these
cuts), distinct segments of a batch are segmented into pieces once, and the pieces' lengths,
summed up and read through the alignment, give the byte span of every piece in the original
text. Decoding goes from ids alone.

Supported: BPE models without user-defined symbols (others raise ``ValueError``).

Defined results: null and empty texts encode to the begin and end ids only and decode to the
empty string; repeated rows encode alike; very long texts are encoded whole (a worker remembers
the pieces of at most about ``REMEMBERED`` segments between batches); empty tables give empty results.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import textbatch as tb
from .common import bounded_batches

MARK = "▁"
REMEMBERED = 200_000
ENCODED = StructType([StructField("ids", ArrayType(IntegerType())), StructField("begin", ArrayType(IntegerType())),
                      StructField("end", ArrayType(IntegerType()))])
DIGESTS = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                      StructField("decoded_sha256", StringType()), StructField("spans_sha256", StringType())])


class CharacterMap:
    """The compiled map: a size, a double-array trie, then zero-terminated replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.replacements = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.replacements = blob[4 + size:]
        starts = "".join(re.escape(c) for c in self._first_characters())
        self.candidate = re.compile(f"[{starts}]") if starts else None

    def _offset(self, unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _first_characters(self) -> list[str]:
        """Characters whose bytes are a path in the trie (only these can begin a match)."""
        if not self.units:
            return []
        found, todo = [], [(b"", self._offset(self.units[0]))]
        while todo:
            path, at = todo.pop()
            for byte in range(1, 256):
                unit = self.units[at ^ byte] if at ^ byte < len(self.units) else 0
                if unit & 0x800000FF != byte:
                    continue
                longer = path + bytes([byte])
                try:
                    found.append(longer.decode())
                except UnicodeDecodeError:
                    if len(longer) < 4:
                        todo.append((longer, (at ^ byte) ^ self._offset(unit)))
        return found

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest prefix in the map at ``at``."""
        best, node = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit & 0x100:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        stop = self.replacements.index(b"\0", best[1])
        return best[0], self.replacements[best[1]:stop]

    def apply(self, text: str) -> tuple[bytes, np.ndarray]:
        """(mapped bytes, source byte of each of them and of the end)."""
        data = text.encode()
        if not self.candidate or not self.candidate.search(text):
            return data, np.arange(len(data) + 1)
        out, source = [], []
        done = 0
        starts = np.cumsum([0, *(len(c.encode()) for c in text)]) if not text.isascii() else None
        for m in self.candidate.finditer(text):
            at = m.start() if starts is None else int(starts[m.start()])
            if at < done:
                continue
            match = self.longest(data, at)
            if match is None:
                continue
            out += [data[done:at], match[1]]
            source += [np.arange(done, at), np.full(len(match[1]), at)]
            done = at + match[0]
        out.append(data[done:])
        source.append(np.arange(done, len(data) + 1))
        return b"".join(out), np.concatenate(source)


class Encoder:
    """One model, ready to encode and decode; built once per Python worker."""

    def __init__(self, model: bytes):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kinds = pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("only BPE models without user-defined symbols are supported")
        norm = proto.normalizer_spec
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        if self.suffix:
            raise ValueError("models with white space as a suffix are not supported")
        # The library below gets text that is normalised already and only segments it.
        norm.precompiled_charsmap, norm.name = b"", "identity"
        norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
        self.segmenter = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.bos, self.eos, self.unk = self.segmenter.bos_id(), self.segmenter.eos_id(), self.segmenter.unk_id()
        self.unk_surface = proto.trainer_spec.unk_surface.encode()
        # Surface of every id: control ids say nothing, byte pieces one byte, others their text.
        self.surface, self.raw = [], np.zeros(len(proto.pieces), bool)
        within = set()
        crossing = False
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.raw[i] = True
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == kinds.CONTROL:
                self.surface.append(b"")
            elif p.type == kinds.UNKNOWN:
                self.surface.append(self.unk_surface)
            else:
                self.surface.append(p.piece.replace(MARK, " ").encode())
                if len(p.piece) > 1:
                    within |= set(p.piece)
                    crossing |= MARK in p.piece.lstrip(MARK)
        # A segment: marks and the mergeable characters after them, or one character that never
        # merges. A model with marks inside pieces gets each text as one segment.
        letters = "".join(re.escape(c) for c in sorted(within - {MARK}))
        self.segments = re.compile(f"{MARK}*[{letters}]+|{MARK}+|[^{letters}{MARK}]") if letters and not crossing else None
        self.widths = np.array([len(x.replace(b" ", MARK.encode())) for x in self.surface])
        self.inner = np.array([r and x[0] & 0xC0 == 0x80 for r, x in zip(self.raw, self.surface)])
        self.known: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised UTF-8, source byte of each byte and of the end)."""
        data, source = self.map.apply(text)
        if self.squeeze:
            kept = np.ones(len(data), bool)
            raw = np.frombuffer(data, np.uint8)
            blank = raw == 0x20
            kept[1:] = ~(blank[1:] & blank[:-1])
            inside = np.flatnonzero(~blank)
            if not len(inside):
                return b"", np.array([len(text.encode())])
            kept[:inside[0]] = False
            kept[inside[-1] + 1:] = False
            end = source[inside[-1] + 1]
            source = np.append(source[:-1][kept], end)
            data = raw[kept].tobytes()
        if not data:
            return b"", source[-1:]
        if self.prefix:
            data, source = b" " + data, np.concatenate([source[:1], source])
        if self.escape:
            raw = np.frombuffer(data, np.uint8)
            width = np.where(raw == 0x20, 3, 1)
            source = np.append(np.repeat(source[:-1], width), source[-1])
            data = data.replace(b" ", MARK.encode())
        return data, source

    def _spans(self, ids: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source span of each piece: lengths in normalised bytes, summed up and read through the
        alignment. Of the byte pieces of one character the last covers it, those before are empty."""
        lengths = self.widths[ids]
        raw = np.flatnonzero(self.raw[ids])
        if len(raw):
            inner = self.inner[ids]  # continuation bytes
            closes = np.ones(len(raw), bool)
            closes[:-1] = ~((raw[1:] == raw[:-1] + 1) & inner[raw[1:]])
            ends = np.flatnonzero(closes)
            lengths[raw] = 0
            lengths[raw[ends]] = np.diff(np.concatenate([[-1], ends]))
        stop = np.cumsum(lengths)
        return source[stop - lengths], source[stop]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """For each text: ids as little-endian 32-bit integers, begin and end byte of every piece
        in the source; the begin and end ids stand at the text's edges with empty spans."""
        known, cuts, sources = self.known, [], []
        new: set[str] = set()
        for text in texts:
            data, source = self.normalise(text or "")
            norm = data.decode()
            cut = self.segments.findall(norm) if self.segments else [norm] if norm else []
            new.update(set(cut).difference(known))
            cuts.append(cut)
            sources.append(source)
        fresh = list(new)
        for text, ids in zip(fresh, self.segmenter.encode(fresh, num_threads=1)):
            known[text] = array("I", ids).tobytes()
        for cut, source in zip(cuts, sources):
            ids = b"".join([known[s] for s in cut])
            begin, end = self._spans(np.frombuffer(ids, "<u4"), source)
            edge = source[-1:]
            yield (struct.pack("<I", self.bos) + ids + struct.pack("<I", self.eos), np.concatenate([[0], begin, edge]),
                   np.concatenate([[0], end, edge]))
        if len(known) > REMEMBERED:  # the segments met first, so the frequent ones, stay
            for text in fresh:
                del known[text]

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that form no character become U+FFFD one by one."""
        listed = np.frombuffer(ids, "<u4")
        listed = listed[(listed != self.bos) & (listed != self.eos)]
        surface = self.surface
        data = b"".join([surface[i] for i in listed.tolist()])
        if len(listed) and self.prefix and not self.squeeze and not self.raw[listed[0]] and data[:1] == b" ":
            data = data[1:]
        elif self.squeeze:
            data = data.lstrip(b" ") if len(listed) and not self.raw[listed[0]] else data
        return data.decode(errors="each_byte")


codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
_encoders: dict[str, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    key = hashlib.sha256(model).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encoded(spark: SparkSession, text: Column, model: bytes, decode: bool = False) -> Column:
    """Column: struct of ``ids`` and the byte spans ``begin``, ``end`` of each text's pieces; with
    ``decode`` also ``decoded_sha256``, the hash of the text the ids decode to.
    ``model`` is the content of the model file (its size is that of the vocabulary)."""
    bounded_batches()
    held = spark.sparkContext.broadcast(model)

    @arrow_udf(StructType([*ENCODED.fields, StructField("decoded_sha256", StringType())]) if decode else ENCODED)
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = encoder(held.value)
        for batch in texts:
            for part in tb.slices(batch, tb.SLICE):
                rows = [(np.frombuffer(ids, "<i4"), begin.astype(np.int32), end.astype(np.int32)) for ids, begin, end in of.encode(part.to_pylist())]
                columns = [_lists([r[j] for r in rows]) for j in range(3)]
                if decode:
                    columns.append(pa.array([hashlib.sha256(of.decode(r[0].tobytes()).encode()).hexdigest() for r in rows], pa.string()))
                yield pa.StructArray.from_arrays(columns, names=["ids", "begin", "end", "decoded_sha256"][:len(columns)])

    return made(text)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32))


def digests(spark: SparkSession, text: Column, model: bytes) -> Column:
    """Column: struct of the number of ids and the hashes of the ids, of the text decoded from
    them and of the spans; the arrays stay in the worker that made them."""
    bounded_batches()
    held = spark.sparkContext.broadcast(model)

    @arrow_udf(DIGESTS)
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = encoder(held.value)
        sha = hashlib.sha256
        for part in (part for batch in texts for part in tb.slices(batch, tb.SLICE)):
            rows = [(len(ids) // 4, sha(ids).hexdigest(), sha(of.decode(ids).encode()).hexdigest(),
                     sha(np.stack([begin, end]).astype("<u4").tobytes()).hexdigest()) for ids, begin, end in of.encode(part.to_pylist())]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]],
                                             names=["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return made(text)
