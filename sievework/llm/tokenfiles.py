"""Token-ID output: documents encoded by a public tokenizer, in binary files coded by rans.

A file holds some millions of tokens of whole documents:

    magic SWTK, version, lanes, part, file, tokens before it in its part
    shared frequency table | document index (ids, token counts) | block directory
    blocks: end states, words

Header and directory have a crc32, and so has each block. The files are the `data` values of a table
that Spark's own writer commits, so any store that Spark reads can hold them and a lost executor's
files are written again, never twice. Parts are ranges of ascending doc_id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .arrowtext import Texts, Words, hashed, names, slices, sums, texts_of

MAGIC = b"SWTK"
_HEAD = struct.Struct("<4sHHIIIQQQIIII")


def pack(ids: list[int | None], counts: np.ndarray, tokens: np.ndarray, part: int, file: int, before: int, lanes: int = 1024, block: int = 1 << 18) -> bytes:
    """One file."""
    table = rans.Table.of(tokens)
    f, c = table.encoder()
    known = np.array([i is not None for i in ids], dtype=np.uint8)
    index = zlib.compress(known.tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + counts.astype("<u8").tobytes(), 1)
    freq = zlib.compress(table.symbols.astype("<u4").tobytes() + table.freq.astype("<u4").tobytes(), 1)
    directory, body, at = [], [], 0
    for i in range(0, len(tokens), block):
        own = tokens[i : i + block]
        width = min(lanes, max(1, len(own) // 64))
        states, words = rans.encode(own, f, c, width)
        data = states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        directory.append(struct.pack("<IIQII", len(own), width, at, len(words), zlib.crc32(data)))
        body.append(data)
        at += len(data)
    blocks = b"".join(directory)
    head = _HEAD.pack(MAGIC, 1, 0, lanes, part, file, before, len(ids), len(tokens), len(freq), len(index), len(blocks), len(table.symbols))
    top = head + freq + index + blocks
    return top + struct.pack("<I", zlib.crc32(top)) + b"".join(body)


def unpack(data: bytes) -> tuple[int, int, int, list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """(part, file, tokens before, ids, counts, blocks' tokens). Raises ValueError where a checksum fails."""
    magic, version, _, _, part, file, before, n_docs, _, n_freq, n_index, n_blocks, n_symbols = _HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token file")
    at = _HEAD.size
    end = at + n_freq + n_index + n_blocks
    if zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("header checksum fails")
    freq = np.frombuffer(zlib.decompress(data[at : at + n_freq]), "<u4")
    index = zlib.decompress(data[at + n_freq : at + n_freq + n_index])
    known = np.frombuffer(index, np.uint8, n_docs)
    ids = np.frombuffer(index, "<i8", n_docs, n_docs)
    counts = np.frombuffer(index, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    table = rans.Table(freq[:n_symbols], freq[n_symbols:].astype(np.int64))

    def blocks() -> Iterator[np.ndarray]:
        slots = table.slots()
        for n, width, offset, n_words, crc in struct.iter_unpack("<IIQII", data[end - n_blocks : end]):
            own = data[end + 4 + offset : end + 4 + offset + 8 * width + 4 * n_words]
            if zlib.crc32(own) != crc:
                raise ValueError("block checksum fails")
            yield rans.decode(np.frombuffer(own, "<u8", width).astype(np.uint64), np.frombuffer(own, "<u4", n_words, 8 * width), n, table, slots)

    return part, file, before, [int(i) if k else None for i, k in zip(ids, known, strict=True)], counts, blocks()


def block_of(data: bytes, number: int) -> np.ndarray:
    """The tokens of one block, decoded without the others: the directory says where it lies, its end states are where decoding starts."""
    head = _HEAD.unpack_from(data)
    n_freq, n_index, n_blocks, n_symbols = head[9:13]
    end = _HEAD.size + n_freq + n_index + n_blocks
    freq = np.frombuffer(zlib.decompress(data[_HEAD.size : _HEAD.size + n_freq]), "<u4")
    table = rans.Table(freq[:n_symbols], freq[n_symbols:].astype(np.int64))
    n, width, offset, n_words, crc = struct.unpack_from("<IIQII", data, end - n_blocks + number * struct.calcsize("<IIQII"))
    own = data[end + 4 + offset : end + 4 + offset + 8 * width + 4 * n_words]
    if zlib.crc32(own) != crc:
        raise ValueError("block checksum fails")
    return rans.decode(np.frombuffer(own, "<u8", width).astype(np.uint64), np.frombuffer(own, "<u4", n_words, 8 * width), n, table, table.slots())


def documents_of(counts: np.ndarray, blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Each document's tokens; never more than a block and a document at once."""
    rest = np.zeros(0, np.uint32)
    for n in counts:
        have = [rest]
        while sum(map(len, have)) < n:
            have.append(next(blocks))
        rest = np.concatenate(have) if len(have) > 1 else rest
        yield rest[:n]
        rest = rest[n:]


def _blank_before(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before byte `at` is white space: ASCII with its separators, or Unicode's."""
    back = lambda k: np.where(at >= k, buf[np.maximum(at - k, 0)], 0)
    a, b, c = back(1), back(2), back(3)
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    e2 = (c == 0xE2) & (((b == 0x80) & (((a >= 0x80) & (a <= 0x8A)) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))) | ((b == 0x81) & (a == 0x9F)))
    three = e2 | ((c == 0xE1) & (b == 0x9A) & (a == 0x80)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))
    return ((a >= 9) & (a <= 13)) | ((a >= 28) & (a <= 32)) | two | three


def _pool(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + size[i] - 1, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Encoder:
    """The tokenizer, called once for each distinct piece of some texts, with a bounded table of known pieces.

    Cut before a blank that follows a non-blank, a text's pieces tokenize alone as they do within it,
    as no pre-token spans such a cut. So new pieces go to the tokenizer as one text; the bytes that each
    id stands for tell where a piece ends. Pieces are found by a 64-bit hash and known by their bytes (by a
    cryptographic digest beyond 16 of them); a slice in which a hash is not a piece's own is tokenized as it is.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.length = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        special = {a.content for a in self.tokenizer.get_added_tokens_decoder().values()}
        for token, i in self.tokenizer.get_vocab().items():
            self.length[i] = len(token.encode()) if token in special else len(token)
        self.exact = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        #: Of each piece: its name and its length in bytes.
        self.name = np.zeros((0, 3), np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.dtype)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, t: Texts, w: Words, h: np.ndarray, name: np.ndarray) -> None:
        """Adds the distinct pieces w of t, of hashes h and names, to the table."""
        size = w.end - w.start
        safe = (t.buf[w.start] == 0x20) & ~_blank_before(t.buf, w.end)
        one = np.flatnonzero(safe)
        own: list[np.ndarray] = []
        count = np.zeros(len(h), np.int64)
        if len(one):
            ids = np.array(self.tokenizer.encode_batch_fast([t.buf[_pool(w.start[one], size[one])].tobytes().decode()], add_special_tokens=False)[0].ids, self.dtype)
            upto, ends = np.cumsum(self.length[ids]), np.cumsum(size[one])
            at = np.searchsorted(upto, ends)
            if len(ids) and np.array_equal(upto[np.minimum(at, len(ids) - 1)], ends):
                count[one] = np.diff(np.concatenate([[-1], at]))
                own.append(ids)
            else:
                safe[:] = False
        rest = np.flatnonzero(~safe)
        late = self.plain([t.buf[i:j].tobytes().decode() for i, j in zip(w.start[rest], w.end[rest], strict=True)])
        count[rest] = [len(x) for x in late]
        order = np.concatenate([np.flatnonzero(safe), rest])
        start = np.cumsum(count[order]) - count[order] + len(self.ids)
        self.ids = np.concatenate([self.ids, *own, *late])
        everything = np.concatenate([self.hash, h[order]])
        by = np.argsort(everything, kind="stable")
        self.name = np.concatenate([self.name, name[order]])[by]
        self.hash, self.start, self.size = everything[by], np.concatenate([self.start, start])[by], np.concatenate([self.size, count[order].astype(np.int32)])[by]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and the number of each."""
        if not self.exact:
            out = self.plain([x or "" for x in column.to_pylist()])
            return np.concatenate([np.zeros(0, self.dtype), *out]), np.array([len(x) for x in out], np.int64)
        t = texts_of(column)
        blank = np.flatnonzero(t.buf == 0x20)
        cut = np.zeros(len(t.buf) + 1, dtype=bool)
        cut[blank[~_blank_before(t.buf, blank)]] = True
        cut[t.offsets] = True
        edge = np.flatnonzero(cut)
        w = Words(edge[:-1], edge[1:], np.searchsorted(edge, t.offsets))
        if not len(w.start):
            return np.zeros(0, self.dtype), np.zeros(len(t), np.int64)
        head, tail = names(t, w)
        name = np.stack([head, tail, (w.end - w.start).astype(np.uint64)], 1)
        each, first, which = np.unique(hashed(*name.T), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, each)
        new = (at == len(self.hash)) | (self.hash[np.minimum(at, max(len(self.hash) - 1, 0))] != each if len(self.hash) else True)
        if new.any():
            if len(self.hash) + new.sum() > self.most:
                self.forget()
                new = np.ones(len(each), dtype=bool)
            i = first[new]
            self.learn(t, Words(w.start[i], w.end[i], w.first), each[new], name[i])
            at = np.searchsorted(self.hash, each)
        if (self.name[at][which] != name).any():
            out = self.plain([x or "" for x in column.to_pylist()])
            return np.concatenate([np.zeros(0, self.dtype), *out]), np.array([len(x) for x in out], np.int64)
        start, size = self.start[at][which], self.size[at][which].astype(np.int64)
        return self.ids[_pool(start, size)], sums(size, w.first)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _encoders[vocabulary] = Encoder(path)
    return _encoders[vocabulary]


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, file_tokens: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes files in ascending doc_id order to path.

    A null or empty text is its end id alone; a text of any length is encoded whole and lies in one file.
    Null ids come first; rows of one id stand in the order of a hash of their texts, repeated rows next to
    each other. An empty table gives no file. Other columns are not read. vocabulary: an absolute path,
    or a name in public_tokenizers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a range holds an id's rows together unless they are many: then their text and where they came from divide them
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie", "part").sortWithinPartitions("doc_id", "tie", "part").select("doc_id", "text")

    def code(batches):
        from pyspark import TaskContext

        tool, part, file, before = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        counts: list[np.ndarray] = []
        tokens: list[np.ndarray] = []

        def flush():
            nonlocal ids, counts, tokens, file, before
            data = pack(ids, np.concatenate(counts), own := np.concatenate(tokens), part, file, before)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([data], pa.binary())], names=["part", "file", "n_docs", "n_tokens", "data"])
            ids, counts, tokens, before, file = [], [], [], before + len(own), file + 1
            return out

        for whole in batches:
            for b in slices(whole, most=4 << 20):
                own, n = tool.encode(b.column(1))
                ids += b.column(0).to_pylist()
                counts.append(n + 1)
                tokens.append(np.insert(own, np.cumsum(n), end_id))
                if sum(map(len, tokens)) >= file_tokens:
                    yield flush()
        if ids:
            yield flush()

    rows.mapInArrow(code, "part int, file int, n_docs long, n_tokens long, data binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids_crc32, decoded from the files of path.

    The driver only gets a sum for each part; blocks are decoded one at a time.
    """
    files = spark.read.parquet(path)
    sums = sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    start, total = {}, 0
    for r in sums:
        start[r["part"]], total = total, total + r["n"]

    def back(batches):
        for b in batches:
            for data in b.column(0):
                part, _, before, ids, counts, blocks = unpack(data.as_buffer().to_pybytes())
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in documents_of(counts, blocks)]
                at = start[part] + before + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a batch of files would be many files' bytes at once
    return files.select("data").mapInArrow(back, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame) -> DataFrame:
    """Writes docs' tokens to the shared folder and gives what read_tokens finds there."""
    import uuid

    from .tables import shared_dir

    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_tokens(spark, path)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import table

    return token_files(table(spark, sf_dir, "documents"))
