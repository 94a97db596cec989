"""Token-id files: each document's ids compressed on their own with one shared zstandard dictionary.

File layout (little-endian): magic ``CLTOK1\0\0``, 32 bytes SHA-256 of the dictionary, u64 number of documents,
u64 length of the index, then the index, then the frames. The index is, per document, i64 doc_id, u64 first id's
number within the whole corpus, u64 number of ids, u64 offset of the frame, u32 CRC of the ids, u32 flags (1: the
document has no doc_id). A document is read by its index entry and one range of bytes; the dictionary lies once
beside the files and is found by its hash.

Executors share no folder that Python can write to, so Spark writes the files as values of a binary column, one row
a file, with the range of doc_ids that it holds; Spark's committer makes a file whole or absent.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_long, materialise, payloads, ragged, slices

MAGIC = b"CLTOK1\0\0"
_HEAD = struct.Struct("<8s32sQQ")
_ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("count", "<u8"), ("offset", "<u8"), ("crc", "<u4"), ("flags", "<u4")])
_FILE = T.StructType(
    [T.StructField("first_row", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("content", T.BinaryType())]
)

# Letters and digits below U+0250; other characters send a text to the library whole.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"
)
_FOREIGN = re.compile(r"[^\t\n\r\x20-\x7e\xa0-ɏ–—‘-„…€]")
#: UTF-8 bytes of which no foreign character consists alone, but for U+0080 to U+009F.
_COMMON = b"\t\n\r" + bytes(range(0x20, 0x7F)) + bytes(range(0x80, 0xC0)) + bytes(range(0xC2, 0xC9))


class Encoder:
    """``Tokenizer.encode`` of whole texts, with the ids of known pieces remembered.

    A byte-level tokenizer splits a text into pieces by a fixed pattern and encodes each alone, so the ids of a text
    are those of its pieces. New pieces go to the library in one call a batch. Texts with characters for which the
    pattern above is not known to split alike, or with a special token's text, go to the library whole.
    """

    def __init__(self, path: str, end_id: int, most_pieces: int = 800_000, most_chars: int = 24 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.most, self.most_chars = end_id, most_pieces, most_chars
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.full(1 << 16, self.end_id, np.uint32)
        self.starts, self.counts = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64)
        self.used = self.n = 1  # piece 0 is the end id
        self.chars = 0

    def _add(self, ids: list[int] | np.ndarray, counts: np.ndarray) -> int:
        """Append pieces by their ids and counts; the first one's number."""
        first, stop = self.n, self.n + len(counts)
        while stop > len(self.starts):
            self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[first:stop] = self.used + np.cumsum(counts) - counts
        self.counts[first:stop] = counts
        self.used += len(ids)
        self.n = stop
        return first

    def _learn(self, pieces: list[str]) -> None:
        words, others = [], []
        self.chars += sum(map(len, pieces))
        for p in pieces:  # " a b c" splits into " a", " b", " c" again
            (words if p[0] == " " and p[1:].isalpha() else others).append(p)
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            e = self.tokenizer.encode("".join(part), add_special_tokens=False)
            counts = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            first = self._add(e.ids, counts)
            self.number.update(zip(part, range(first, first + len(part))))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        if found:
            first = self._add([x for ids in found for x in ids], np.array([len(ids) for ids in found], np.int64))
            self.number.update(zip(others, range(first, first + len(others))))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts, the end id after each, and how many ids each has."""
        if len(self.number) > self.most or self.chars > self.most_chars:
            self.clear()
        split = []
        for data in texts:
            text = data.decode()
            whole = (data.translate(None, _COMMON) or b"\xc2" in data) and _FOREIGN.search(text) or "<|endoftext|>" in text
            split.append(text if whole else _PIECES.findall(text))
        fresh = list(set().union(*(s for s in split if type(s) is list)).difference(self.number))
        if fresh:
            self._learn(fresh)
        known = self.n, self.used
        numbers, sizes, number = [], [], self.number.__getitem__
        for pieces in split:
            if type(pieces) is str:  # a piece of its own, for this batch only
                ids = self.tokenizer.encode(pieces, add_special_tokens=False).ids
                numbers.append((self._add(ids, np.array([len(ids)])),))
            else:
                numbers.append(map(number, pieces))
            sizes.append(1 if type(pieces) is str else len(pieces))
            numbers.append((0,))
        at = np.fromiter(itertools.chain.from_iterable(numbers), np.int64, sum(sizes) + len(sizes))
        counts = self.counts[at]
        ends = np.cumsum(np.array(sizes, np.int64) + 1)
        per_text = np.diff(np.concatenate(([0], np.cumsum(counts)[ends - 1])))
        ids = self.flat[ragged(self.starts[at], counts)]
        self.n, self.used = known  # whole texts' ids are forgotten
        return ids, per_text


@functools.lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> Encoder:
    """A worker process's encoder: pieces learned in one task serve the next."""
    return Encoder(path, end_id)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int = 2, sample_docs: int = 2000, sample_chars: int = 16384, sample_ids: int = 4096, size: int = 65536) -> bytes:
    """A dictionary from the serialized ids of at most ``sample_docs`` documents (least hash of the id first).

    Of a longer text ``sample_chars`` characters are read, from a place that a hash of the id names, and of these
    ``sample_ids`` ids are used; of an id with several texts the least is read. The sample shapes only how well frames
    compress. Empty if it is too small to train on; frames are then compressed without a dictionary.
    """
    ids = docs.select(as_long("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(sample_docs)
    texts = docs.select(as_long("doc_id"), "text").join(F.broadcast(ids), "doc_id").where("length(text) > 0")  # the sample's bound bounds the broadcast
    start = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.lit(1), F.length("text") - sample_chars + 1).cast("long")).cast("int") + 1
    texts = texts.select("doc_id", F.substr("text", start, F.lit(sample_chars)).alias("text")).groupBy("doc_id").agg(F.min("text").alias("text"))
    encoder = Encoder(tokenizer_path, end_id)
    samples = [encoder.encode([row["text"].encode()])[0][:sample_ids].astype("<u4").tobytes() for row in texts.toLocalIterator()]
    samples.sort()
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes, level: int = 3):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True, write_checksum=False).compress


def pack(rows: list[tuple[int | None, int, int, int, bytes]], digest: bytes) -> bytes:
    """A file of ``(doc_id, start, number of ids, their CRC, frame)`` in order; ``digest`` is the dictionary's."""
    index, offset = np.zeros(len(rows), _ENTRY), 0
    for k, (doc_id, start, n, crc, frame) in enumerate(rows):
        index[k] = (doc_id or 0, start, n, offset, crc, doc_id is None)
        offset += len(frame)
    table = index.tobytes()
    return b"".join([_HEAD.pack(MAGIC, digest, len(rows), len(table)), table, *(r[-1] for r in rows)])


class TokenFile:
    """Range reads of documents from a file's bytes (bytes, memoryview or mmap)."""

    def __init__(self, content, dictionary: bytes) -> None:
        magic, digest, n, size = _HEAD.unpack_from(content, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.content, self.base = memoryview(content), _HEAD.size + size
        self.index = np.frombuffer(content, _ENTRY, n, _HEAD.size)
        self.ends = np.append(self.index["offset"][1:], len(content) - self.base) if n else np.empty(0)
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def ids(self, k: int) -> np.ndarray:
        entry = self.index[k]
        raw = self.decompress(self.content[self.base + int(entry["offset"]) : self.base + int(self.ends[k])], max_output_size=4 * int(entry["count"]))
        if zlib.crc32(raw) != entry["crc"]:
            raise ValueError(f"document {entry['doc_id']} is damaged")
        return np.frombuffer(raw, "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each row of a document, by the index alone."""
        return [self.ids(int(k)) for k in np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["flags"] == 0))]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, dictionary: bytes | None = None, file_bytes: int = 8 << 20, file_docs: int = 50_000, level: int = 3) -> tuple[DataFrame, bytes]:
    """Encode, order by doc_id, and write the files; returns the table of files and the dictionary.

    Documents are range-partitioned by (doc_id, hash of the text) before encoding, so texts are shuffled once, each file
    holds a range, and equal doc_ids have one order whatever the partitions. Encoding first was measured: the frames
    would have to be written before they are sampled for ranges, which took more disk than the texts' exchange. A
    partition's documents are cut into files of about ``file_bytes`` of ids. Starts within a partition are counted while
    encoding; the partitions' sums (one row each) then give what lies before each.
    """
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer_path, end_id)
    hashed = docs.select(as_long("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compress, digest = _encoder(tokenizer_path, end_id), compressor(shared.value, level), hashlib.sha256(shared.value).digest()
        held, size, start, rows_before = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, rows_before
            content = [pa.array([rows_before]), pa.array([len(held)]), pa.array([sum(x[2] for x in held)]), pa.array([pack(held, digest)], pa.binary())]
            rows_before += len(held)
            held, size = [], 0
            return pa.RecordBatch.from_arrays(content, names=_FILE.names)

        for whole in batches:
            for batch in slices(whole, most=2 << 20):
                ids, counts = encoder.encode(payloads(batch.column(1)))
                data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
                for doc_id, n, end in zip(batch.column(0).to_pylist(), counts.tolist(), ends.tolist()):
                    raw = data[end - 4 * n : end]
                    held.append((doc_id, start, n, zlib.crc32(raw), compress(raw)))
                    start += n
                    size += len(raw)
                    if size >= file_bytes or len(held) >= file_docs:
                        yield flush()
        if held:
            yield flush()

    files = rows.mapInArrow(scan, _FILE).withColumn("part", F.spark_partition_id())
    return materialise(files, "tokens", compression="uncompressed"), dictionary


_DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
)


def part_starts(files: DataFrame) -> DataFrame:
    """part -> ids in all earlier parts: one row for each written partition."""
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")).alias("before"))


def read_tokens(files: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files' frames.

    Every frame is decompressed and its CRC taken anew. Files know starts within their partition; the part's offset
    is added here.
    """
    shared = files.sparkSession.sparkContext.broadcast(dictionary)
    placed = files.join(F.broadcast(part_starts(files)), "part").select("before", "content")  # a row for each partition

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = TokenFile(content.as_buffer(), shared.value)
                n = len(file.index)
                crcs = np.fromiter((zlib.crc32(file.ids(k)) for k in range(n)), np.int64, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.index["doc_id"].astype(np.int64), mask=file.index["flags"] != 0),
                        pa.array(file.index["start"].astype(np.int64) + before),
                        pa.array(file.index["count"].astype(np.int64)),
                        pa.array(crcs),
                    ],
                    names=_DOC.names,
                )

    return placed.mapInArrow(scan, _DOC)


def tokenise(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write and read back. Null and empty texts hold the end id alone; repeated rows each have their place (equal
    doc_ids by a hash of the text); rows without doc_id come first, as nulls sort; an empty table has no rows."""
    files, dictionary = write_tokens(docs, tokenizer_path, **options)
    return read_tokens(files, dictionary)
