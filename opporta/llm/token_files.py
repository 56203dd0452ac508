"""Token ids as compact files: canonical length-limited Huffman codes from global counts.

A stream of ids is cut into blocks of whole documents. A block's bits decode on their own; a checkpoint, the bit offset
of every `CHECKPOINT`-th id, lets a reader start there. Decoding looks up `MAX_BITS` bits at a time in a table that
gives the id and its length, for all checkpoints at once.
"""

from __future__ import annotations

import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opporta.llm import common

END = 0  # id appended to each document
MAX_BITS = 18
BLOCK_IDS = 16_384  # a block ends with the document that reaches this
CHECKPOINT = 512
GROUP_BYTES = 4_000_000  # of coded blocks decoded at a time (more only for one longer block)
TEXT_BYTES = 8_000_000  # of texts encoded at a time
RUNS = 100_000  # words whose ids are copied at a time
CACHED_WORDS = 1_000_000  # of which a worker remembers the ids, about 20 bytes each
_TYPE = np.uint32


class WordCache:
    """Encodes whole texts with a byte-level tokenizer, each distinct word of some texts once.

    Byte-level pre-tokenization starts a new piece at a space unless white space surrounds it, so the ids of a text are
    those of its words, each with the space before it. Texts with a space inside other white space, or with a zero byte,
    are given to the tokenizer as they are. Unknown words are encoded together with a zero byte after each, which the vocabulary has in
    no longer piece, so it parts the words and changes none.
    """

    SPACES = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    ZERO = "\u0100"  # how byte-level vocabularies write the zero byte

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(self.ZERO) if sum(self.ZERO in piece for piece in self.tokenizer.get_vocab()) == 1 else None  # else each word goes alone
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.words, self.flat = pa.array([], pa.string()), np.zeros(0, dtype=self.kind)
        self.start, self.size, self.used = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def each(self, words: list[str]) -> list[bytes]:
        """Ids of each word on its own."""
        if self.separator is None or any(w[-2:].isspace() for w in words):
            return [self.whole(w) for w in words]
        out: list[bytes] = []
        for a in range(0, len(words), 5_000):
            text = "\0".join([*words[a:a + 5_000], ""])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)
            cuts = np.flatnonzero(ids == self.separator).tolist()
            raw, step = ids.tobytes(), ids.itemsize
            out += [raw[step * b:step * e] for b, e in zip([0, *(c + 1 for c in cuts)], cuts, strict=False)]
        return out

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words with a space in front: all ids, and the place and number of each word's.

        A word of letters with ASCII punctuation after it has two pieces, so its letters are looked up on their own.
        """
        core = pc.utf8_rtrim(words, characters=string.punctuation)
        core = pc.if_else(pc.utf8_is_alpha(core), core, words)
        coded = core.dictionary_encode()
        if len(self.words) > CACHED_WORDS:
            self._forget()
        entry = pc.index_in(coded.dictionary, value_set=self.words)
        new = np.flatnonzero(entry.is_null().to_numpy(zero_copy_only=False))
        entry = pc.fill_null(entry, 0).to_numpy().copy()
        if len(new):
            entry[new] = len(self.words) + np.arange(len(new))
            self._remember(coded.dictionary.take(pa.array(new)))
        piece = entry[coded.indices.to_numpy()]
        self.used[piece] = True
        longer = np.flatnonzero(pc.binary_length(words).to_numpy() - pc.binary_length(core).to_numpy())
        size = (pc.utf8_length(words).to_numpy() - pc.utf8_length(core).to_numpy())[longer]
        tails = [w[-n:] for w, n in zip(words.take(pa.array(longer)).to_pylist(), size.tolist(), strict=True)]
        distinct = {t: k for k, t in enumerate(dict.fromkeys(tails))}
        tail_ids = self.each([*distinct])
        tail_size = np.array([len(x) // self.flat.itemsize for x in tail_ids], dtype=np.int64)
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(tail_ids), dtype=self.kind)])
        start, many = np.zeros(2 * len(words), dtype=np.int64), np.zeros(2 * len(words), dtype=np.int64)
        start[::2], many[::2] = self.start[piece], self.size[piece]
        which = np.array([distinct[t] for t in tails], dtype=np.int64)
        start[2 * longer + 1] = (len(self.flat) + np.cumsum(tail_size) - tail_size)[which]
        many[2 * longer + 1] = tail_size[which]
        whole = many[::2] + many[1::2]
        return _taken(flat, start, many), np.cumsum(whole) - whole, whole

    def _forget(self) -> None:
        """Drop the words that were not met since the last time."""
        keep = np.flatnonzero(self.used)
        self.flat, self.size = _taken(self.flat, self.start[keep], self.size[keep]), self.size[keep]
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.words, self.used = self.words.take(pa.array(keep)), np.zeros(len(keep), dtype=bool)

    def _remember(self, new: pa.Array) -> None:
        ids = self.each([" " + w for w in new.to_pylist()])
        self.words = pa.concat_arrays([self.words, new])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), dtype=self.kind)])
        self.size = np.concatenate([self.size, np.array([len(x) // self.flat.itemsize for x in ids], dtype=np.int32)])
        self.used = np.concatenate([self.used, np.zeros(len(new), dtype=bool)])
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, one after another, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, f"{self.SPACES} (?:{self.SPACES}|$)|\\x00").to_numpy(zero_copy_only=False))
        alone = [self.whole(texts[i].as_py()) for i in odd.tolist()]
        if len(odd):
            mask = np.zeros(len(texts), dtype=bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        word = coded.indices.to_numpy().copy()
        firsts = pc.take(split.flatten(), pa.array(at[:-1])).dictionary_encode()
        flat, start, size = self.known(coded.dictionary)
        more = [*self.each(firsts.dictionary.to_pylist()), *alone, np.array([END], dtype=self.kind).tobytes()]
        more_size = np.array([len(x) // flat.itemsize for x in more], dtype=np.int64)
        start, size = np.concatenate([start, len(flat) + np.cumsum(more_size) - more_size]), np.concatenate([size, more_size])
        flat = np.concatenate([flat, np.frombuffer(b"".join(more), dtype=self.kind)])
        word[at[:-1]] = firsts.indices.to_numpy() + len(coded.dictionary)
        word[at[odd]] = np.arange(len(odd)) + len(coded.dictionary) + len(firsts.dictionary)
        word = np.insert(word, at[1:], len(size) - 1)
        ends = np.cumsum(size[word])[at[1:] + np.arange(len(texts))]
        return _taken(flat, start, size, word), np.diff(np.r_[0, ends])


def _taken(flat: np.ndarray, start: np.ndarray, many: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """Runs of `flat`, one after another: all of them, or those that `which` names. The places of a few runs at a time are held."""
    parts = [flat[:0]]
    for a in range(0, len(many if which is None else which), RUNS):
        some = slice(a, a + RUNS) if which is None else which[a:a + RUNS]
        own = many[some]
        total = np.cumsum(own, dtype=np.int64)
        at = np.repeat(start[some] - (total - own), own)
        at += np.arange(total[-1])
        parts.append(flat[at])
    return np.concatenate(parts)


def _coder(path: str) -> WordCache:
    return common.worker_state("word cache", path, lambda: WordCache(path))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaf = counts[order].astype(np.float64) if counts.max() >= 1 << 40 else counts[order].astype(np.int64)
    lists, items = [], leaf
    for level in range(limit):
        if level:
            pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
            items = np.concatenate([leaf, pairs])
            rank = np.argsort(items, kind="stable")
            lists.append(rank < len(leaf))
            items = items[rank]
        else:
            lists.append(np.ones(len(leaf), dtype=bool))
    take, depth = 2 * len(used) - 2, np.zeros(len(used) + 1, dtype=np.int64)
    for is_leaf in reversed(lists):
        leaves = int(is_leaf[:take].sum())
        depth[0] += 1
        depth[leaves] -= 1
        take = 2 * (take - leaves)
    lengths[order] = np.cumsum(depth)[:-1]
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes from lengths alone: by length, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    for length in np.unique(lengths[order]).tolist():
        own = order[lengths[order] == length]
        code <<= length - last
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, last = code + len(own), length
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of one block, first bit highest, and the bit offsets of its checkpoints."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    value = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
    total = int(ends[-1]) + 7 >> 3
    words = np.bincount(at >> 5, weights=(value >> np.uint64(32)).astype(np.float64), minlength=(total >> 2) + 2)
    words += np.bincount((at >> 5) + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=(total >> 2) + 2)
    return words.astype(">u4").tobytes()[:total], at[::CHECKPOINT]


def decoding_table(lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For every value of the next `MAX_BITS` bits the id, times 32, plus its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spread = np.int64(1) << (MAX_BITS - lengths[order].astype(np.int64))
    table = np.ones(1 << MAX_BITS, dtype=_TYPE)
    table[:int(spread.sum())] = np.repeat(order << 5 | lengths[order], spread)
    return table


def unpack(blocks: list[bytes], offsets: list[np.ndarray], counts: list[int], table: np.ndarray) -> np.ndarray:
    """Ids of some blocks, one after another; all checkpoints advance together."""
    raw = b"".join([*blocks, bytes(CHECKPOINT * MAX_BITS // 8 + 8)])
    ahead = np.ndarray((len(raw) - 3,), ">u4", raw, strides=(1,))  # 32 bits from each byte on
    base = np.cumsum([0, *map(len, blocks)])[:-1] * 8
    at = np.concatenate([o + b for o, b in zip(offsets, base, strict=True)]).astype(np.int64)
    lanes = np.concatenate([np.minimum(CHECKPOINT, n - np.arange(0, n, CHECKPOINT)) for n in counts])
    out = np.empty((CHECKPOINT, len(at)), dtype=_TYPE)
    shift = np.uint32(32 - MAX_BITS)
    for k in range(int(lanes.max())):
        out[k] = found = table[ahead[at >> 3].astype(np.uint32) << (at & 7).astype(np.uint32) >> shift]
        at += found & 31
    return (out >> 5).T[np.arange(CHECKPOINT)[None, :] < lanes[:, None]]


_BLOCKS = "part int, first bigint, doc_ids array<bigint>, sizes array<bigint>, wide boolean, ids binary, counts binary"
_FILES = "start bigint, doc_ids array<bigint>, sizes array<bigint>, checkpoints array<bigint>, bits binary"


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `TEXT_BYTES` of text (more only for one longer text)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if i > start and held + n > TEXT_BYTES:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(size):
        yield start, len(size)


def _blocks(ordered: DataFrame, tokenizer: str) -> DataFrame:
    """Ids of the ordered rows `doc_id, text` as blocks; `first`: ids before the block in its partition.

    Each partition ends with a row that has only `counts`: how often each id occurs in it.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, coder, first = TaskContext.get().partitionId(), _coder(tokenizer), 0
        names, sizes, ids, held, seen = [], [], [], 0, np.zeros(0, dtype=np.int64)

        def block(counts: bytes | None = None) -> pa.RecordBatch:
            flat = np.concatenate(ids).tobytes() if ids else b""
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([coder.kind is np.uint32]), pa.array([flat], pa.binary()), pa.array([counts], pa.binary())], names=["part", "first", "doc_ids", "sizes", "wide", "ids", "counts"])
        for batch in batches:
            for a, b in _parts(batch.column(1)):
                got, many = coder.encode(batch.column(1).slice(a, b - a))
                for k in range(0, len(got), RUNS):
                    seen = _added(seen, np.bincount(got[k:k + RUNS]))
                begin = 0
                for name, n in zip(batch.column(0).slice(a, b - a).to_pylist(), many.tolist(), strict=True):
                    names.append(name)
                    sizes.append(n)
                    ids.append(got[begin:begin + n])
                    begin, held = begin + n, held + n
                    if held >= BLOCK_IDS:
                        yield block()
                        first += held
                        names, sizes, ids, held = [], [], [], 0
                del got, many
                common.give_back()
        if names:
            yield block()
            first += held
            names, sizes, ids = [], [], []
        if first:
            yield block(seen.tobytes())
    return ordered.mapInArrow(encode, _BLOCKS)


def _ids(blocks: pa.RecordBatch, k: int) -> np.ndarray:
    return np.frombuffer(blocks["ids"][k].as_buffer(), dtype=np.uint32 if blocks["wide"][k].as_py() else np.uint16)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two arrays, the shorter one filled up with zeros."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    out = long.astype(np.int64)
    out[:len(short)] += short
    return out


def _id_counts(blocks: DataFrame) -> np.ndarray:
    """Occurrences of each id, from the counts of all partitions. The result has a number for each id of the vocabulary."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for counts in batch["counts"]:
                total = _added(total, np.frombuffer(counts.as_buffer(), dtype=np.int64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])
    rows = blocks.where("counts IS NOT NULL").select("counts").mapInArrow(tally, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append the end id, and write the stream in ascending order of the ids.

    `path/codes` has the length of each id's code, `path/blocks` the blocks with the number of ids before each. Null
    texts are empty; null ids come first; rows with the same id are ordered by a hash of their text.
    """
    spark = docs.sparkSession
    common.bound_batches(spark, 2_000)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    stored = common.stored(_blocks(ordered, tokenizer), "token-blocks")
    lengths = code_lengths(_id_counts(stored))
    # Files in the order of their names, and rows inside a file, go on in the order of the ids, whatever splits the scan makes.
    blocks = stored.where("counts IS NULL").drop("counts").repartitionByRange("part", "first").sortWithinPartitions("part", "first")
    totals = blocks.select("part", (F.col("first") + F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("n")).groupBy("part").agg(F.max("n").alias("n"))
    before, base = 0, {}
    for r in sorted(totals.collect()):  # a number for each partition
        base[r.part], before = before, before + r.n
    sent = spark.sparkContext.broadcast((lengths, canonical(lengths), base))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, codes, offset = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                bits, marks = pack(_ids(one, 0), size, codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([offset[one["part"][0].as_py()] + one["first"][0].as_py()]), one["doc_ids"], one["sizes"], pa.array([marks.tolist()], pa.list_(pa.int64())),
                     pa.array([bits], pa.binary())], names=["start", "doc_ids", "sizes", "checkpoints", "bits"])
    some = np.flatnonzero(lengths)
    table = spark.createDataFrame(list(zip(some.tolist(), lengths[some].tolist(), strict=True)), T.StructType([T.StructField("id", T.LongType()), T.StructField("bits", T.LongType())]))
    table.coalesce(1).write.parquet(f"{path}/codes")
    blocks.mapInArrow(code, _FILES).write.option("compression", "none").parquet(f"{path}/blocks")
    common.forget(stored)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of the files: `doc_id, start, n_tokens, ids` (little-endian unsigned 32-bit), or `ids_crc32` of these."""
    known = spark.read.parquet(f"{path}/codes").collect()  # a row for each id of the vocabulary
    lengths = np.zeros(max((r.id for r in known), default=0) + 1, dtype=np.uint8)
    for r in known:
        lengths[r.id] = r.bits
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, lengths))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size = sent.value
        table = common.worker_state("decoding table", key, lambda: decoding_table(size, canonical(size)))
        for batch in batches:
            start = held = 0
            for k in range(batch.num_rows):
                held += len(batch["bits"][k].as_buffer())
                if held >= GROUP_BYTES or k == batch.num_rows - 1:
                    yield _documents(batch.slice(start, k + 1 - start), table, digest)
                    start, held = k + 1, 0
            common.give_back()
    return spark.read.schema(_FILES).parquet(f"{path}/blocks").mapInArrow(
        decode, f"doc_id bigint, start bigint, n_tokens bigint, {'ids_crc32 bigint' if digest else 'ids binary'}")


def _documents(group: pa.RecordBatch, table: np.ndarray, digest: bool) -> pa.RecordBatch:
    sizes = [np.array(x) for x in group["sizes"].to_pylist()]
    ids = unpack(group["bits"].to_pylist(), [np.array(x) for x in group["checkpoints"].to_pylist()], [int(x.sum()) for x in sizes], table)
    starts = np.concatenate([s + np.cumsum(x) - x for s, x in zip(group["start"].to_pylist(), sizes, strict=True)])
    flat = np.concatenate(sizes)
    ends = np.cumsum(flat)
    own = (ids[a:b].astype("<u4").tobytes() for a, b in zip(ends - flat, ends, strict=True))
    last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array([*own], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([i for x in group["doc_ids"].to_pylist() for i in x], pa.int64()), pa.array(starts), pa.array(flat), last],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all texts to new files in the shared folder, read the files back, and digest what was read."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = common.shared_folder(docs.sparkSession, "token-files")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path, digest=True)


def brute(rows: list[tuple], tokenizer: str) -> list[tuple]:
    """The same digest made plainly, for tests on small inputs."""
    from tokenizers import Tokenizer
    coder, before, out = Tokenizer.from_file(tokenizer), 0, []
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, END]
        out.append((name, before, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        before += len(ids)
    return out
