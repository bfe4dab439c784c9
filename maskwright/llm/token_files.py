"""Token-ID files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds, in this order (the zstandard seekable format):

* one zstandard frame for each document, in ascending document order: the document's ids as
  little-endian unsigned integers of `width` bytes;
* an index frame (a skippable frame, magic 0x184D2A5D): width, document ids and a null flag for each;
* the seek table (a skippable frame, magic 0x184D2A5E): for each frame before it (the index frame, which holds no
  content, included) its compressed size, decompressed size and checksum (low 32 bits of XXH64 of the content), then the
  number of frames, a descriptor byte (0x80: with checksums) and the magic number 0x8F92EAB1, which ends the file.

Spark's text sink writes the files, so that they go to any Hadoop file system and through its commit protocol. Each file is one
value; the line separator that the sink puts after it is the last three bytes of the closing magic number, which are one UTF-8
character. So the bytes of a file are those above and no others.

Rows: null text is empty (only the end id). Rows that repeat a doc_id all stay, ordered by their ids'
bytes; a null doc_id comes first. An empty table gives no file with documents. Texts may be of any length: each is one frame.
Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, keeps, let_go, parts_for, shuffles_removed, texts_in_batches, workspace

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: The last bytes of FOOTER_MAGIC, as a character: EA 92 8F.
CLOSING = struct.pack("<I", FOOTER_MAGIC)[1:].decode()
#: The low 32 bits of XXH64 of no bytes.
NO_CONTENT = 0x51D8E999
#: White space that str.split() splits at but that the tokenizer may not; texts with it are encoded whole.
ODD_SPACE = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
#: The last of the Latin, Greek and Cyrillic letters.
ALPHABETS = "\u052f"
BYTES_PER_FILE = 8 << 20
#: Chunks whose ids a Python worker keeps: the first ones, and some of the rest.
MEMO, RARE = 300_000, 200_000


class ChunkEncoder:
    """The tokenizer's ids of whole texts. It drops white space and never joins across it, so a text's ids
    are its chunks' ids in order; chunks are encoded once for each worker while the memo has room."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(True), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        #: The first MEMO chunks; and some of the others, emptied when full.
        self.memo: dict[str, bytes] = {}
        self.rare: dict[str, bytes] = {}
        self.mark = {m: self.encode_one(m) for m in ".,"}
        self.model = self.tokenizer.model
        # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def bytes_of(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode_one(self, text: str) -> bytes:
        return self.bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode_word(self, word: str) -> bytes:
        """The ids of letters alone, which are one word to the tokenizer: its model takes them lower-cased and, beyond ASCII,
        composed and in the byte-level alphabet. Letters that other tables may class otherwise take the long way."""
        if not word.isascii():
            if max(word) > ALPHABETS or "\u03a3" in word or "\u0130" in word:
                return self.encode_one(word)
            word = "".join(map(self.alphabet.__getitem__, unicodedata.normalize("NFC", word).lower().encode()))
        return self.bytes_of([t.id for t in self.model.tokenize(word)])

    def encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks of letters, with at most a full stop or comma after them, go by words; others are encoded alone."""
        memo, rare = self.memo, self.rare
        stems = {c: (w.lower() if w.isascii() else w) for c in chunks for w in (c[:-1] if c[-1] in self.mark else c,)}
        known = {w for w in stems.values() if w.isalpha()}
        found = {w: memo.get(w) or rare[w] for w in known if w in memo or w in rare}
        found |= {w: self.encode_word(w) for w in known if w not in found}
        return {c: (found[w] if len(w) == len(c) else found[w] + self.mark[c[-1]]) if w in found else self.encode_one(c) for c, w in stems.items()}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        memo, rare = self.memo, self.rare
        chunks = [[] if not t or ODD_SPACE.search(t) else t.split() for t in texts]
        rows = [list(map(memo.get, some)) for some in chunks]
        lacking = [[k for k, v in enumerate(row) if v is None] if None in row else [] for row in rows]
        wanted = {some[k] for some, own in zip(chunks, lacking, strict=True) for k in own}
        ids = {c: rare[c] for c in wanted if c in rare}
        new = self.encode_chunks([c for c in wanted if c not in ids])
        ids |= new
        if len(memo) + len(new) <= MEMO:
            memo.update(new)
        else:
            if len(rare) + len(new) > RARE:
                rare.clear()
            rare.update(new)
        out = []
        for text, some, row, own in zip(texts, chunks, rows, lacking, strict=True):
            for k in own:
                row[k] = ids[some[k]]
            out.append((b"".join(row) if some or not text else self.encode_one(text)) + self.end)
        return out


@lru_cache(2)
def encoder_of(path: str, end_id: int) -> ChunkEncoder:
    """One for each Python worker, whose tasks share its memo."""
    return ChunkEncoder(path, end_id)


keeps("token_files", encoder_of.cache_clear)


def _encode_batches(path: str, end_id: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import xxhash
        import zstandard

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        claim("token_files")
        encoder, press = encoder_of(path, end_id), zstandard.ZstdCompressor(level=1, write_checksum=True)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            shard = [0 if i is None else int(np.searchsorted(bounds, i, "left")) for i in ids]
            for at in range(0, len(ids), 250):
                raw = encoder.encode(batch.column(1).slice(at, 250).to_pylist())
                n = len(raw)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[at : at + n], pa.int32()),
                        pa.array(ids[at : at + n], pa.int64()),
                        pa.array([press.compress(x) for x in raw], pa.binary()),
                        pa.array([len(x) for x in raw], pa.int64()),
                        pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in raw], pa.int64()),
                        pa.array([encoder.dtype.itemsize] * n, pa.int32()),
                    ],
                    names=["shard", "doc_id", "frame", "size", "checksum", "width"],
                )
        let_go()

    return run


def _file_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: a file's frames, its index and its seek table, without the closing characters."""
    ids, frames, sizes, width = [], [], [], 2
    for batch in batches:
        own = batch.column("frame").to_pylist()
        frames += own
        ids += batch.column("doc_id").to_pylist()
        sizes += zip(map(len, own), batch.column("size").to_pylist(), batch.column("checksum").to_pylist(), strict=True)
        width = batch.column("width")[0].as_py() if len(own) else width
    if ids:
        index = struct.pack("<II", width, len(ids)) + np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is None for i in ids)
        sizes.append((len(index) + 8, 0, NO_CONTENT))
        table = b"".join(struct.pack("<III", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0x80, FOOTER_MAGIC)
        whole = b"".join([*frames, struct.pack("<II", INDEX_MAGIC, len(index)), index, struct.pack("<II", SEEK_MAGIC, len(table)), table])
        yield pa.RecordBatch.from_arrays([pa.array([whole[: -len(CLOSING.encode())]], pa.binary())], names=["bytes"])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Encodes docs (doc_id, text) and writes the files to `path`, one for each range of doc_ids.

    One shuffle moves compressed frames, never texts. The ranges come from quantiles of doc_id, whose
    number grows with the input, so a file keeps its size."""
    docs = texts_in_batches(docs.select(F.col("doc_id").cast("long"), "text"))
    n = parts_for(docs, bytes_per_file)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    bounds = np.array(sorted(set(cuts or [])), np.int64)
    frames = docs.mapInArrow(_encode_batches(tokenizer_path, end_id, bounds), "shard int, doc_id long, frame binary, size long, checksum long, width int")
    files = frames.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("doc_id", "size", "checksum", "frame")
    as_text = files.mapInArrow(_file_bytes, "bytes binary").select(F.col("bytes").cast("string").alias("value"))
    with shuffles_removed(docs.sparkSession):
        as_text.write.option("lineSep", CLOSING).option("compression", "none").text(path)


class TokenFile:
    """Reads one file's bytes (or a memory map, or what `read_range` gives of a file of `size` bytes); reads and decompresses only the
    seek table, the index and the documents that are asked for."""

    def __init__(self, data: bytes | memoryview = b"", read_range: Callable[[int, int], bytes] | None = None, size: int = 0):
        self.bytes = read_range or (lambda at, n: bytes(data[at : at + n]))
        self.ids, self.entries = [], np.zeros((0, 3), np.int64)
        end = size if read_range else len(data)
        if end < 17:
            return
        n, _, magic = struct.unpack("<IBI", self.bytes(end - 9, 9))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table at the end of the file")
        entries = np.frombuffer(self.bytes(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.cumsum(entries[:, 0]) - entries[:, 0]
        self.entries = entries[:-1]
        index = self.bytes(int(self.offsets[-1]), int(entries[-1, 0]))
        magic, _, self.width, n = struct.unpack_from("<IIII", index)
        if magic != INDEX_MAGIC:
            raise ValueError("no index after the last frame")
        ids, nulls = np.frombuffer(index, "<i8", n, 16).tolist(), index[16 + 8 * n : 16 + 9 * n]
        self.ids = [None if gone else i for i, gone in zip(ids, nulls, strict=True)]

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def lengths(self) -> np.ndarray:
        return self.entries[:, 1] // self.width if len(self) else np.zeros(0, np.int64)

    def read(self, k: int, press) -> np.ndarray:
        """The ids of the k-th document. Raises ValueError if the bytes don't match their checksum."""
        import xxhash

        at, (packed, size, checksum) = int(self.offsets[k]), self.entries[k]
        raw = press.decompress(self.bytes(at, int(packed)), max_output_size=int(size)) if size else b""
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = [TokenFile(c) for c in batch.column("content").to_pylist()]
        first = [next((i for i in f.ids if i is not None), None) for f in files]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(first, pa.int64()), pa.array([int(f.lengths.sum()) for f in files], pa.int64())], names=["path", "first_id", "n"])


def _documents(starts: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                file = TokenFile(content.as_buffer() if len(content.as_buffer() or b"") else b"")
                lengths = file.lengths
                start = starts[path] + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(file) else lengths
                for at in range(0, len(file), 2000):
                    some = range(at, min(at + 2000, len(file)))
                    crc = [zlib.crc32(file.read(k, press).astype("<u4").tobytes()) for k in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.ids[at : at + 2000], pa.int64()), pa.array(start[at : at + 2000], pa.int64()), pa.array(lengths[at : at + 2000], pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids before it, over all files), n_tokens, ids_crc32.

    The driver gets one row for each file (its first id and its number of tokens), from the seek tables."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    totals = sorted(files.mapInArrow(_totals, "path string, first_id long, n long").collect(), key=lambda r: (r.first_id is not None, r.first_id or 0))
    starts, at = {}, 0
    for r in totals:
        starts[r.path], at = at, at + r.n
    return files.mapInArrow(_documents(starts), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_requested(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the requested documents only: of each file its seek table and its index are read, then the frames asked for.
    Where Arrow can't open the file system itself, files come whole through Spark; still no other frame is decompressed."""
    from pyarrow import fs

    wanted = frozenset(doc_ids)
    try:
        fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        ranged = True
    except (pa.ArrowInvalid, OSError):
        ranged = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if ranged:
                    system, at = fs.FileSystem.from_uri(name if "://" in name else name.replace("file:", "file://", 1))
                    with system.open_input_file(at) as source:
                        hits, found = requested(TokenFile(read_range=lambda at, n, f=source: f.read_at(n, at), size=content.as_py()), press)
                else:
                    hits, found = requested(TokenFile(content.as_buffer()), press)
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    def requested(file: TokenFile, press) -> tuple[list[int], list[list[int]]]:
        hits = [k for k, i in enumerate(file.ids) if i in wanted]
        return [file.ids[k] for k in hits], [file.read(k, press).tolist() for k in hits]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "length" if ranged else "content").mapInArrow(run, "doc_id long, ids array<long>")


def token_files_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes docs to files in the shared folder, reads them back, and returns what read_token_files returns."""
    path = workspace(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, path)
