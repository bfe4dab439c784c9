"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Spaces become the marker U+2581 and one marker is put before the text. The best segmentation has the largest sum of the
pieces' scores (the model file's own). A character that no piece covers is spelled by the byte pieces of its UTF-8 form, at a
score of UNKNOWN_PENALTY below the least piece's; so is a marker that stands in the text itself, which makes decoding exact. Of
segmentations with equal scores the one with the longest last piece counts, then the longest before it, and so on.

No piece has a marker after another character, so the best segmentation of a text is that of its parts, which start at a
run of markers; parts are kept in a memo for each worker. (A model that has such pieces is encoded text by text.)

Rows: null text is empty and has no pieces; repeated rows and null ids each give a row; an empty table gives none. Other
columns are ignored. Texts may be of any length: time is linear in it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, keeps, let_go, texts_in_batches

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts whose ids a Python worker keeps, twice: the first ones, and some of the others.
MEMO = 250_000


class DoubleArray:
    """A trie in two arrays over bytes: from node s, byte b leads to t = base[s] + b + 1 if check[t] == s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for value, key in enumerate(keys):
            at = 0
            for b in key:
                step = children[at].get(b)
                if step is None:
                    step = len(children)
                    children.append({})
                    children[at][b] = step
                at = step
            if key:
                ends[at] = value
        size = 2 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], free, high = 0, 257, 257
        todo = [(0, 0)]
        while todo:
            node, slot = todo.pop()
            value[slot] = ends.get(node, -1)
            codes = sorted(b + 1 for b in children[node])
            if not codes:
                continue
            while check[free] != -1:
                free += 1
            # One child needs one free slot; more look for room among the last slots that are in use.
            start = max(1, free - codes[0], high - 64 if len(codes) > 1 else 0)
            while True:
                if start + 257 >= len(check):
                    grow = len(check)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                if all(check[start + c] == -1 for c in codes):
                    break
                start += 1
            base[slot] = start
            high = max(high, start + codes[-1])
            for b, step in children[node].items():
                check[start + b + 1] = slot
                todo.append((step, start + b + 1))
        self.base, self.check, self.value = base, check, value

    def prefixes(self, data: bytes, at: int) -> list[tuple[int, int]]:
        """(end, value) of the keys that data has at `at`."""
        base, check, value = self.base, self.check, self.value
        out, s, size = [], 0, len(check)
        for k in range(at, len(data)):
            t = base[s] + data[k] + 1
            if t >= size or check[t] != s or t == 0:
                break
            s = t
            if value[s] >= 0:
                out.append((k + 1, value[s]))
        return out


class PieceCodec:
    def __init__(self, model_file: str, memo: int = MEMO):
        from sentencepiece import SentencePieceProcessor

        self.room = memo
        model = SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.setup({i: (pieces[i], model.get_score(i)) for i in plain}, {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}, n)

    def setup(self, pieces: dict[int, tuple[str, float]], byte_ids: dict[int, int], n: int) -> None:
        self.ids = list(pieces)
        self.scores = [s for _, s in pieces.values()]
        self.trie = DoubleArray([p.encode() for p, _ in pieces.values()])
        self.unknown = min(self.scores, default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = byte_ids
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<i4")
        self.whole = any(re.search(f"[^{MARKER}]{MARKER}", p) for p, _ in pieces.values())
        self.newline = any("\n" in p for p, _ in pieces.values())
        self.cut = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+" if self.newline else f"\n|{MARKER}*[^{MARKER}\n]+|{MARKER}+")
        self.shown = {i: p.replace(MARKER, " ").encode() for i, (p, _) in pieces.items()} | {i: bytes([b]) for b, i in byte_ids.items()}
        #: The first parts; and some of the others, emptied when full.
        self.memo: dict[str, bytes] = {}
        self.rare: dict[str, bytes] = {}

    def best(self, part: str) -> tuple[list[int], float]:
        """The best segmentation's ids and its score. part: markers for spaces."""
        data = part.encode()
        n = len(data)
        score, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        score[0] = 0.0
        prefixes, scores = self.trie.prefixes, self.scores
        for at in range(n):
            here = score[at]
            if here == -np.inf or data[at] & 0xC0 == 0x80:
                continue
            first = data[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            known = False
            for end, v in prefixes(data, at):
                known |= end == at + width
                total = here + scores[v]
                if total > score[end]:
                    score[end], back[end] = total, (at, v)
            if not known:
                total = here + self.unknown
                if total > score[at + width]:
                    score[at + width], back[at + width] = total, (at, -1)
        out, end = [], n
        while end:
            at, v = back[end]
            out += [self.ids[v]] if v >= 0 else [self.byte_ids[b] for b in reversed(data[at:end])]
            end = at
        return out[::-1], score[n]

    def part(self, part: str) -> bytes:
        ids = self.rare.get(part)
        if ids is None:
            ids = np.array(self.best(part)[0], self.dtype).tobytes()
            if len(self.memo) < self.room:
                self.memo[part] = ids
            else:
                if len(self.rare) >= self.room:
                    self.rare.clear()
                self.rare[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        memo, own = self.memo, np.array([self.byte_ids[b] for b in MARKER.encode()], self.dtype).tobytes()
        out: list[bytes] = []
        for k, piece in enumerate(text.split(MARKER)):
            if k:
                out.append(own)
            marked = (MARKER if k == 0 else "") + piece.replace(" ", MARKER)
            parts = [marked] if self.whole and marked else self.cut.findall(marked)
            out += [memo.get(p) or self.part(p) for p in parts]
        return np.frombuffer(b"".join(out), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.shown.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


@lru_cache(2)
def codec_of(model_file: str, memo: int = MEMO) -> PieceCodec:
    """One for each Python worker."""
    return PieceCodec(model_file, memo)


keeps("sentence_pieces", codec_of.cache_clear)


def encode_documents(docs: DataFrame, model_file: str, memo: int = MEMO) -> DataFrame:
    """One row for each row: doc_id, n_pieces, ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and
    round_trip: decoding the ids gives the text again, character for character. memo trades a worker's memory for time."""

    texts_in_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sentence_pieces")
        codec = codec_of(model_file, memo)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250)
                texts = [t or "" for t in some.column(1).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([codec.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "ids", "ids_crc32", "round_trip"],
                )
        let_go()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_file)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
