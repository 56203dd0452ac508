"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised through the compiled character map of the model, a double-array trie over UTF-8 bytes: at every byte all
keys that begin there are followed at once in numpy and the longest one counts; from left to right each match or single
character becomes one unit, whose replacement is copied and whose place in the original is noted for every byte. Spaces
are escaped, and trimmed where the model says so. The library merges the normalised text, with a model whose own
normalisation is switched off, and every piece is projected through the alignment to its bytes in the original.

For models of byte-pair type with normal, unknown and control pieces and one piece for each byte; others are refused.

Defined results: a null text is null for `encoded` (empty for `report`); an empty text, or one of spaces that the model trims,
has no pieces but the end. Characters outside the vocabulary become one piece for each byte, the last of which has their span.
Repeated rows are encoded each; an empty table has no rows; added columns get names that the table does not have.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta.llm import common

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
BATCH_BYTES = 1_000_000  # of text in one batch: its ids and spans take twelve times as much
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BPE = 2
_AS_IT_IS = bytes([0x1A, 8, 0x12, 0, 0x18, 0, 0x20, 0, 0x28, 0])  # appended to a model: no character map, no prefix, no trimming, no escaping


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def whole() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(message):
        tag = whole()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, whole()
            continue
        size = whole() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, message[at:at + size]
        at += size


class Normaliser:
    """The normaliser of a model, from its serialized specification."""

    def __init__(self, spec: bytes):
        own = dict(fields(spec))
        chars = own.get(2, b"")
        self.dummy_prefix, self.trim, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        self.trie = np.zeros(0, dtype=np.uint32)
        if chars:
            size = struct.unpack_from("<I", chars)[0]
            self.trie = np.frombuffer(chars, dtype=np.uint32, count=size // 4, offset=4)
            self.strings = np.frombuffer(chars, dtype=np.uint8, offset=4 + size)
            ends = np.flatnonzero(self.strings == 0)
            self.end_of = ends[np.searchsorted(ends, np.arange(len(self.strings)))] if len(ends) else ends

    def _longest(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest key that begins at each byte (0: none), and where its replacement starts."""
        trie = self.trie
        length, value = np.zeros(len(raw), dtype=np.int64), np.zeros(len(raw), dtype=np.int64)

        def offset(unit: np.ndarray) -> np.ndarray:
            return (unit >> 10) << ((unit & 512) >> 6)
        alive = np.arange(len(raw))
        node = np.full(len(raw), offset(trie[:1])[0], dtype=np.uint32)
        depth = 0
        while len(alive):
            byte = raw[alive + depth].astype(np.uint32)
            node = node ^ byte
            inside = node < len(trie)
            unit = trie[np.where(inside, node, 0)]
            fits = inside & ((unit & 0x800000FF) == byte)
            alive, node, unit = alive[fits], node[fits], unit[fits]
            node = node ^ offset(unit)
            depth += 1
            ends = (unit >> 8 & 1) == 1
            length[alive[ends]] = depth
            value[alive[ends]] = trie[node[ends]] & 0x7FFFFFFF
            more = alive + depth < len(raw)
            alive, node = alive[more], node[more]
        return length, value

    def units(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and length in the text of every unit, start and length of its replacement (in text and strings, one after another)."""
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        ends = np.append(starts[1:], len(raw))
        source, many = starts, ends - starts
        if len(self.trie):
            length, value = self._longest(raw)
            taken, free = np.ones(len(starts), dtype=bool), 0
            for k in np.flatnonzero(length[starts] > many).tolist():  # keys of several characters: the first one wins
                if k >= free and taken[k]:
                    free = int(np.searchsorted(starts, starts[k] + length[starts[k]]))
                    taken[k + 1:free] = False
                    ends[k] = starts[k] + length[starts[k]]
            starts, ends, many = starts[taken], ends[taken], many[taken]
            found = length[starts] > 0
            at = value[starts]
            source = np.where(found, len(raw) + at, starts)
            many = np.where(found, self.end_of[at] - at, many)
        return starts, ends - starts, source, many

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the place in the original."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(text, dtype=np.uint8)
        out = raw
        if not len(self.trie):  # every character stays as it is
            at = np.arange(len(raw), dtype=np.int32)
            align = at if text.isascii() else np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, at, 0))
        if len(self.trie) or self.trim:
            start, _, source, many = self.units(raw)
            first = np.cumsum(many) - many
        if len(self.trie):
            both = np.concatenate([raw, self.strings])
            out = both[np.repeat(source - first, many) + np.arange(many.sum())]
            align = np.repeat(start, many)
        begin, end = 0, len(raw)
        if self.trim:
            both = np.concatenate([raw, self.strings]) if len(self.trie) else raw
            blank = (many == 1) & (both[np.minimum(source, len(both) - 1)] == 32)
            if blank.all():
                return b"", np.zeros(1, dtype=np.int64)
            begin = int(start[blank.argmin()])
            space = out == 32
            after = np.append(np.where(~space, np.arange(len(out)), len(out)), len(out))
            after = np.minimum.accumulate(after[::-1])[::-1]  # first byte at or after each that is no space
            own = first[many > 0]
            cut = own[space[own] & ((own == 0) | space[own - 1])]
            upto = np.minimum(after[cut], np.append(own, len(out))[np.searchsorted(own, cut) + 1])
            gone = np.zeros(len(out) + 1, dtype=np.int64)
            np.add.at(gone, cut, 1)
            np.add.at(gone, upto, -1)
            left = np.cumsum(gone[:-1]) == 0
            out, align = out[left], align[left]
        done = out.tobytes()
        if self.escape:
            align, done = np.repeat(align, np.where(out == 32, 3, 1)), done.replace(b" ", SPACE.encode())
        mark = SPACE.encode() if self.escape else b" "
        if self.dummy_prefix:
            done, align = mark + done, np.concatenate([np.full(len(mark), begin, dtype=align.dtype), align])
        if self.trim:
            while done.endswith(mark):
                done = done[:-len(mark)]
                end = int(align[len(done)])
        return done, np.append(align[:len(done)], align.dtype.type(end))


class Coder:
    """A model: its normaliser, and the library's byte-pair merging on text that is normalised already."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        rows = list(fields(model))
        pieces = [dict(fields(v)) for k, v in rows if k == 1]
        kinds = np.array([p.get(3, _NORMAL) for p in pieces])
        trainer = dict(fields(next((v for k, v in rows if k == 2), b"")))
        if trainer.get(3) != _BPE or set(kinds.tolist()) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or (kinds == _BYTE).sum() != 256 or trainer.get(24, 0):
            raise ValueError("not a byte-pair model of normal, unknown, control and byte pieces")
        self.normaliser = Normaliser(next((v for k, v in rows if k == 3), b""))
        self.sizes = np.array([len(p[1]) for p in pieces])
        self.byte = np.full(len(pieces), -1)
        self.byte[kinds == _BYTE] = [int(p[1][1:-1], 16) for p, kind in zip(pieces, kinds, strict=True) if kind == _BYTE]
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=model + _AS_IT_IS)
        self.end = self.processor.eos_id()

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and last byte (exclusive) of each in the original text; the end id stands behind the text."""
        raw = text.encode()
        normal, align = self.normaliser.normalised(raw)
        ids = np.array(self.merger.encode(normal.decode()), dtype=np.int32)
        size, byte = self.sizes[ids], self.byte[ids]
        spelt = np.flatnonzero(byte >= 0)
        if len(spelt):  # of a character given byte by byte the last id takes all
            no = np.cumsum((byte[spelt] & 0xC0) != 0x80) - 1
            size[spelt] = 0
            size[spelt[np.flatnonzero(np.append(np.diff(no), 1))]] = np.bincount(no)
        upto = np.cumsum(size)
        begin, end = align[upto - size], align[upto]
        return np.append(ids, np.int32(self.end)), np.append(begin, len(raw)), np.append(end, len(raw))


def _coder(path: str) -> Coder:
    return common.worker_state("pieces", path, lambda: Coder(path))


_PIECES = "struct<ids:array<int>,begins:array<int>,ends:array<int>>"


def encoded(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """Add a struct of `ids` (the end id last) and the `begins` and `ends` of their bytes in the text. Frame and column name."""
    kind = pa.struct([(k, pa.list_(pa.int32())) for k in ("ids", "begins", "ends")])

    def made(texts: pa.Array) -> pa.Array:
        coder, rows, sizes = _coder(path), [[np.zeros(0, dtype=np.int32)] for _ in range(3)], [0]
        for t in texts:
            own = coder.encoded(t.as_py()) if t.is_valid else [rows[0][0]] * 3
            for all_, values in zip(rows, own, strict=True):
                all_.append(values.astype(np.int32))
            sizes.append(sizes[-1] + len(own[0]))
        cuts = pa.array(sizes, pa.int32())
        lists = []
        while rows:
            lists.append(pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(rows.pop(0)))))
        return pa.StructArray.from_arrays(lists, fields=list(kind), mask=texts.is_null())
    common.bound_batches(docs.sparkSession, size=BATCH_BYTES)
    name = common.free_name(docs, "pieces")
    return docs.withColumn(name, F.arrow_udf(made, _PIECES).asNondeterministic()(F.col(f"`{text}`"))), name


def decoded(docs: DataFrame, path: str, ids: str) -> tuple[DataFrame, str]:
    """Add the text that the library decodes from a column of id lists. Frame and column name."""
    def made(lists: pa.Array) -> pa.Array:
        processor = _coder(path).processor
        return pa.array([processor.decode(x.as_py()) if x.is_valid else None for x in lists], pa.string())
    common.bound_batches(docs.sparkSession, size=BATCH_BYTES)
    name = common.free_name(docs, "decoded_text")
    return docs.withColumn(name, F.arrow_udf(made, "string").asNondeterministic()(F.col(ids))), name


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: number and digest of the ids, digest of what they decode to, bytes of the text, bytes from the first piece's span to the last one's."""
    path = path or public_tokenizers.path(MODEL)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded, pieces = encoded(texts, path)
    out, back = decoded(coded, path, f"{pieces}.ids")
    own = F.col(pieces)
    return out.select(
        "doc_id", F.size(own["ids"]).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(own["ids"].cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(back, 256).alias("decoded_sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.coalesce(F.get(own["ends"], F.size(own["ids"]) - 2) - F.get(own["begins"], F.lit(0)), F.lit(0)).cast("bigint").alias("n_covered"))
