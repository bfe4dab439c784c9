"""Language-model scores: an n-gram trie of order 3 in Elias-Fano levels, sharded over fragments.

The model interpolates trigrams, bigrams and words, with absolute discounting:
P(w | u v) = max(c(uvw) - D, 0) / c(uv) + D n(uv) / c(uv) P(w | v), P(w | v) = max(c(vw) - D, 0) / c(v) + D n(v) / c(v) p(w), with n the
number of different words seen after a context, c(context) the number of words seen after it, and p(w) the unigram probability
(c(w) + 0.1) / (N + 0.1 (V + 1)); after an unseen context it is the next shorter one's. Before a text's first word stand two start signs.
It sums to 1 over the V known tokens and one unknown token.

1. Blocks of documents become token streams over the block's own vocabulary (word hashes of 48 bits); written once.
2. Each block sends its different trigrams u v w, with their training counts, to fragments by the hash of v: so a fragment has all that
   the scores after v need. Very common words v are dealt further: their trigrams by u and v (or, where u is common too, by all three),
   and their bigrams v w once more on their own, by v and w.
3. A fragment adds the counts and builds a trie of its n-grams (NGramTrie: words, followers, contexts, trigrams relative to the
   followers, quantised log10 of the discounted probabilities), memory-mapped, and looks up the blocks' n-grams in it.
4. The blocks get their answers back and sum each document. Counts of common contexts are summed over fragments first.

Counts are exact up to collisions of hashes. Nothing is collected but totals, the common words (fewer than 2 MOST_SHARE) and the
counts of contexts of two of them.

Rows: null text is empty (one end token); a null doc_id isn't held out; repeated rows each give a row and each count in training; an
empty table gives no rows. Texts may be of any length: none is cut, and a block holds one long text at least. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, input_bytes, let_go, stored, texts_in_batches
from .elias_fano import Level, NGramTrie
from .jaccard_join import parts
from .shingles import mix, pack, pack_sorted, unpack, unpack_sorted, words_of

DISCOUNT, ADDED = 0.75, 0.1
#: Tokens of a block; n-grams that a fragment should get; bytes of input (as files) for each token.
BLOCK, PER_FRAGMENT, BYTES_A_TOKEN = 1_000_000, 1_000_000, 4
#: A word with this part of all tokens or more, in a block, is reported; with half of it in all, its n-grams are dealt over all fragments.
MOST_SHARE = 512
#: N-grams travel in so many rounds, each with its own part of the fragments: less disk for shuffles, more time to read blocks.
ROUNDS = 2
START, END = np.uint64(0x5BD1E9955BD1), np.uint64(0xA24BAED4963E)
WORD_BITS = 48  # of a word's hash


def joined(*bodies: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in bodies)


class Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(mod: int):
    def flush(block: int, ids: list, held: list[bool], sizes: list[int], stream: array, words: Vocabulary) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - WORD_BITS)
        tokens, n, out = np.frombuffer(stream, np.uint32), np.array(sizes), np.array(held)
        trained = np.repeat(~out, n)
        counts = np.bincount(tokens[trained], minlength=len(words))
        known = [i is not None for i in ids]
        body = joined(pack(np.array([(i or 0) for i in ids], np.int64).view(np.uint64)), np.packbits(known).tobytes(), np.packbits(out).tobytes(), pack(n), pack(tokens), pack(hashes), pack(counts))
        top = np.flatnonzero(counts >= max(100, counts.sum() // MOST_SHARE)) if len(words) else np.zeros(0, np.int64)
        m = len(top)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block] * (m + 1), pa.int64()),
                pa.array([body] + [None] * m, pa.binary()),
                pa.array([int((n[~out] + 1).sum())] + [None] * m, pa.int64()),
                pa.array([int((~out).sum())] + [None] * m, pa.int64()),
                pa.array([None, *hashes[top].view(np.int64).tolist()], pa.int64()),
                pa.array([None, *counts[top].tolist()], pa.int64()),
            ],
            names=["block", "payload", "train_tokens", "train_docs", "context", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("lm_score")
        block = TaskContext.get().partitionId() << 32
        ids, held, sizes, stream, words = [], [], [], array("I"), Vocabulary()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words_of(text.as_py())
                stream.extend(map(words.__getitem__, own))
                ids.append(doc_id)
                held.append(doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == 0)
                sizes.append(len(own))
                if len(stream) >= BLOCK or len(ids) >= 200_000:
                    yield from flush(block, ids, held, sizes, stream, words)
                    block, ids, held, sizes, stream, words = block + 1, [], [], [], array("I"), Vocabulary()
        if ids:
            yield from flush(block, ids, held, sizes, stream, words)
        del ids, held, sizes, stream, words
        let_go()

    return run


class Block:
    """A block's documents and its different trigrams, ordered by fragment, then by v, u and w (places in `hashes`, which is sorted)."""

    def __init__(self, payload: bytes, hot: np.ndarray, fragments: int):
        ids, known, held, sizes, tokens, hashes, _ = parts(payload)
        sizes = unpack(sizes).astype(np.int64)
        n = len(sizes)
        self.ids = unpack(ids).view(np.int64)
        self.known = np.unpackbits(np.frombuffer(known, np.uint8), count=n).astype(bool)
        self.held = np.unpackbits(np.frombuffer(held, np.uint8), count=n).astype(bool)
        self.sizes = sizes + 1
        every = np.concatenate([unpack(hashes), np.array([START, END])])
        self.hashes, rank = np.unique(every, return_inverse=True)
        rank = rank.astype(np.int32)
        m = len(every) - 2
        # Each document's words and then the end: w; the token before each, or the start: v; the one before that: u.
        ends = np.cumsum(self.sizes) - 1
        self.first = ends - sizes
        w = np.empty(int(self.sizes.sum()), np.int32)
        inner = np.ones(len(w), bool)
        inner[ends] = False
        w[inner] = rank[unpack(tokens).astype(np.int32)]
        w[ends] = rank[m + 1]
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[self.first] = rank[m]
        u = np.empty_like(w)
        u[1:] = v[:-1]
        u[self.first] = rank[m]
        bits = int(len(self.hashes)).bit_length()
        if bits > 21:
            raise ValueError("a block has more than two million words: make BLOCK smaller")
        key = (v.astype(np.int64) << (2 * bits)) | (u.astype(np.int64) << bits) | w
        del u, v, w, inner
        key, of_token = np.unique(key, return_inverse=True)
        of_token = of_token.astype(np.int32)
        counts = np.bincount(of_token[np.repeat(~self.held, self.sizes)], minlength=len(key)).astype(np.int32)
        mask = (1 << bits) - 1
        v, u, w = (key >> (2 * bits)).astype(np.int32), (key >> bits & mask).astype(np.int32), (key & mask).astype(np.int32)
        del key
        self.hot = np.isin(self.hashes, hot)
        hv = self.hashes[v]
        spread = mix(hv)
        common = np.flatnonzero(self.hot[v])
        spread[common] = mix(hv[common] ^ (self.hashes[u[common]] * np.uint64(3)))
        common = common[self.hot[u[common]]]
        spread[common] ^= mix(self.hashes[w[common]] * np.uint64(5))
        fragment = (spread % np.uint64(fragments)).astype(np.int32)
        del spread, hv
        order = np.argsort(fragment, kind="stable")
        self.v, self.u, self.w, self.counts = v[order], u[order], w[order], counts[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.of_token = place[of_token]
        self.cuts = np.searchsorted(fragment[order], np.arange(fragments + 1))
        # The bigrams v w of common words v, by fragment, then v and w.
        own = np.flatnonzero(self.hot[self.v])
        pair, back = np.unique((self.v[own].astype(np.int64) << bits) | self.w[own], return_inverse=True)
        n = np.bincount(back, self.counts[own], len(pair)).astype(np.int32)
        bv, bw = (pair >> bits).astype(np.int32), (pair & mask).astype(np.int32)
        fragment = (mix(self.hashes[bv] ^ (self.hashes[bw] * np.uint64(7))) % np.uint64(fragments)).astype(np.int32)
        order = np.argsort(fragment, kind="stable")
        self.bv, self.bw, self.bn = bv[order], bw[order], n[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.hot_rows, self.bigram_of = own, place[back]
        self.bigram_cuts = np.searchsorted(fragment[order], np.arange(fragments + 1))

    def asked(self, f: int, kind: int) -> tuple[slice, list[np.ndarray]]:
        """Where a fragment's trigrams (kind 3) or bigrams (kind 2) are, and its columns: v, u and w, or v and w."""
        cuts, columns = (self.cuts, [self.v, self.u, self.w]) if kind == 3 else (self.bigram_cuts, [self.bv, self.bw])
        some = slice(int(cuts[f]), int(cuts[f + 1]))
        return some, [c[some] for c in columns]


def groups(*columns: np.ndarray) -> np.ndarray:
    """Where equal rows start, of rows in order."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _requests(hot: np.ndarray, fragments: int, offset: int):
    """Of the fragments `offset`, `offset` + ROUNDS, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm_score")
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(payload.as_py(), hot, fragments)
                for f in range(offset, fragments, ROUNDS):
                    for kind in (2, 3):
                        some, columns = block.asked(f, kind)
                        if some.start == some.stop:
                            continue
                        used = np.zeros(len(block.hashes), bool)
                        for c in columns:
                            used[c] = True
                        local = np.cumsum(used, dtype=np.int32) - 1
                        counts = (block.counts if kind == 3 else block.bn)[some]
                        first, *rest = (local[c] for c in columns)
                        body = joined(pack_sorted(block.hashes[used]), pack(np.diff(first, prepend=0)), *(pack(c) for c in rest), pack(counts))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([number], pa.int64()), pa.array([f * 2 + kind - 2], pa.int32()), pa.array([body], pa.binary())], names=["block", "fragment", "payload"]
                        )
                del block
            let_go()

    return run


def discounted(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.log10((count - DISCOUNT) / total) if len(count) else np.zeros(0)


def summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and their summed counts."""
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    starts = groups(key)
    return key[starts], np.add.reduceat(count, starts) if len(starts) else count[:0]


def _answers(hot: dict[int, int]):
    """What a fragment says of its blocks' n-grams; and the counts of common contexts here, as rows of their own.

    A trigram fragment answers with codes of trigrams and bigrams, the books, and counts and numbers of followers of contexts u v and of v;
    a bigram fragment with codes of bigrams and their book."""
    hot_keys = np.array(sorted(hot), np.uint64)
    hot_counts = np.array([hot[k] for k in sorted(hot)], np.float64)
    names = ["block", "fragment", "answer", "n_new", "v", "u", "total", "n_after"]

    def stats(v: np.ndarray, u: np.ndarray | None, total: np.ndarray, after: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"v": v.view(np.int64), "u": u.view(np.int64) if u is not None else -1, "total": total.astype(np.int64), "n_after": after.astype(np.int64)})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        claim("lm_score")
        kind = int(frame["fragment"].iloc[0]) % 2 + 2
        lists, columns, counts = [], [], []
        for payload in frame["payload"]:
            words, first, *rest, n = parts(payload)
            lists.append(unpack_sorted(words))
            columns.append([np.cumsum(unpack(first), dtype=np.int64).astype(np.int32), *(unpack(c).astype(np.int32) for c in rest)])
            counts.append(unpack(n).astype(np.int32))
        words = np.unique(np.concatenate(lists))
        bits = int(len(words)).bit_length()
        for own, c in zip(lists, columns, strict=True):
            rank = np.searchsorted(words, own).astype(np.int32)
            c[:] = [rank[x] for x in c]
        del lists
        n_words, common = len(words), np.isin(words, hot_keys)
        whole = np.zeros(n_words)
        whole[common] = hot_counts[np.searchsorted(hot_keys, words[common])]
        out, empty = [], Level.build(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if kind == 2:
            key, count = summed(np.concatenate([(c[0][n > 0].astype(np.int64) << bits) | c[1][n > 0] for c, n in zip(columns, counts, strict=True)]), np.concatenate([n[n > 0] for n in counts]))
            v, w = key >> bits, key & ((1 << bits) - 1)
            n_after = np.bincount(v, minlength=n_words)
            trie = NGramTrie.build(words, 1 << WORD_BITS, Level.build(n_after, w, discounted(count, whole[v])), empty, empty)
            for c in columns:
                out.append(joined(pack(trie.after.code(trie.after.find(c[0].astype(np.int64), c[1]))), trie.after.book.astype("<f8").tobytes()))
            live = np.flatnonzero(n_after)
            more, new = stats(words[live], None, np.bincount(v, count, n_words)[live], n_after[live]), 0
        else:
            contexts = np.concatenate([((c[0].astype(np.int64) << bits) | c[1])[groups(c[0], c[1])] for c in columns])
            contexts.sort()
            contexts = contexts[groups(contexts)]
            pairs = []
            for c in columns:  # each block's different contexts, and which of them each n-gram has
                starts = groups(c[0], c[1])
                own = np.searchsorted(contexts, (c[0][starts].astype(np.int64) << bits) | c[1][starts])
                pairs.append((own, np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(starts, append=len(c[0])))))
            # The blocks' different trigrams, and which of them each of theirs is; those with a count are the model's.
            asked, place = np.unique(np.concatenate([(p[k] << bits) | c[2] for (p, k), c in zip(pairs, columns, strict=True)]), return_inverse=True)
            place = place.astype(np.int32)
            count = np.bincount(place, np.concatenate(counts), len(asked))
            of, w = (asked[count > 0] >> bits), asked[count > 0] & ((1 << bits) - 1)
            of_asked, w_asked, count = asked >> bits, asked & ((1 << bits) - 1), count[count > 0]
            del asked, counts
            of_v = contexts >> bits
            total, n_after = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
            two, follower = np.unique((of_v[of] << bits) | w, return_inverse=True)
            count2 = np.bincount(follower, count, len(two))
            v2 = two >> bits
            total2, n_after2 = np.bincount(v2, count2, n_words), np.bincount(v2, minlength=n_words)
            # Bigrams of common words are counted apart; here they only number the followers.
            after = Level.build(n_after2, two & ((1 << bits) - 1), discounted(np.maximum(count2, 1), total2[v2]))
            before = Level.build(np.bincount(of_v, minlength=n_words), contexts & ((1 << bits) - 1))
            whole_pair = np.where(common[of_v] & common[contexts & ((1 << bits) - 1)], 1.0, total)
            relative = follower - (np.cumsum(n_after2) - n_after2)[of_v[of]]
            tri = Level.build(n_after, relative, discounted(count, whole_pair[of]))
            trie = NGramTrie.build(words, 1 << WORD_BITS, after, before, tri)
            del count, of, w, two, follower, count2, v2, relative, after, before, tri
            codes2, codes3 = trie.find(of_v[of_asked], contexts & ((1 << bits) - 1), of_asked, w_asked)
            del of_asked, w_asked
            at = 0
            for c, (own, _) in zip(columns, pairs, strict=True):
                mine = place[at : at + len(c[0])]
                at += len(c[0])
                code2, code3 = codes2[mine], codes3[mine]
                starts = groups(c[0])
                v = c[0][starts]
                out.append(
                    joined(pack(code3), trie.tri.book.astype("<f8").tobytes(), pack(code2), trie.after.book.astype("<f8").tobytes(), pack(total[own].astype(np.int64)), pack(n_after[own]), pack(total2[v].astype(np.int64)), pack(n_after2[v]))
                )
            u = contexts & ((1 << bits) - 1)
            live = np.flatnonzero(common[of_v] & common[u] & (n_after > 0))
            more = stats(words[of_v[live]], words[u[live]], total[live], n_after[live])
            new = int(((n_after2 > 0) & ~common).sum())
        answers = pd.DataFrame({"block": frame["block"], "fragment": frame["fragment"], "answer": out, "n_new": [new] + [0] * (len(out) - 1)})
        del trie
        let_go()
        # As nullable integers before they meet: as floats hashes would lose bits.
        whole_rows = [x.reindex(columns=names).astype({c: "Int64" for c in names if c != "answer"}) for x in (answers, more)]
        return pd.concat(whole_rows) if len(more) else whole_rows[0]

    return run


def _scores(hot: dict[int, int], contexts: tuple[np.ndarray, ...], fragments: int, n_tokens: int, n_docs: int, n_words: int):
    """contexts: v, u (-1: none), count and followers of common contexts, ordered by v and u."""
    hot_keys = np.array(sorted(hot), np.uint64)
    hot_counts = np.array([hot[k] for k in sorted(hot)], np.float64)
    cv, cu, ctotal, cafter = contexts
    single = cu == -1
    numbered = (np.searchsorted(hot_keys, cv.view(np.uint64)) << 32) | np.where(single, 0, np.searchsorted(hot_keys, cu.view(np.uint64)) + 1)
    order = np.argsort(numbered)
    numbered, ctotal, cafter = numbered[order], ctotal[order].astype(np.float64), cafter[order].astype(np.float64)

    def common(v: np.ndarray, u: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Count and followers of contexts of common words, given by hashes; 0 where there are none."""
        key = (np.searchsorted(hot_keys, v) << 32) | (0 if u is None else np.searchsorted(hot_keys, u) + 1)
        if not len(numbered):
            return np.zeros(len(v)), np.zeros(len(v))
        at = np.minimum(np.searchsorted(numbered, key), len(numbered) - 1)
        ok = numbered[at] == key
        return np.where(ok, ctotal[at], 0.0), np.where(ok, cafter[at], 0.0)

    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        claim("lm_score")
        if blocks.empty:
            return pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
        block = Block(blocks["payload"].iloc[0], hot_keys, fragments)
        m, n = len(block.hashes), len(block.v)
        count, distinct = np.zeros(m), np.zeros(m)
        seen3, seen2 = np.zeros(n, np.float32), np.zeros(n, np.float32)
        share3 = np.ones(n, np.float32)
        bigram = np.zeros(len(block.bv), np.float32)

        def values(codes: bytes, book: bytes) -> np.ndarray:
            codes, book = unpack(codes).astype(np.uint8), np.concatenate([[0.0], 10.0 ** np.frombuffer(book, "<f8")])
            return book[codes]

        for f, answer in zip(answers["fragment"], answers["answer"], strict=True):
            some, columns = block.asked(f // 2, f % 2 + 2)
            body = parts(answer)
            if f % 2 == 0:
                bigram[some] = values(*body)
                continue
            v, u, _ = columns
            seen3[some], seen2[some] = values(body[0], body[1]), values(body[2], body[3])
            total, after, total2, after2 = (unpack(x).astype(np.float64) for x in body[4:])
            starts = groups(v, u)
            hv, hu = v[starts], u[starts]
            both = block.hot[hv] & block.hot[hu]
            total[both], after[both] = common(block.hashes[hv[both]], block.hashes[hu[both]])
            share = np.where(total > 0, DISCOUNT * after / np.maximum(total, 1), 1.0)
            each = np.diff(starts, append=len(v))
            share3[some] = np.repeat(share, each)
            # Trigrams after a context of two common words were answered with count - DISCOUNT alone.
            seen3[some] /= np.repeat(np.where(both, np.maximum(total, 1), 1.0), each)
            starts = groups(v)
            count[v[starts]], distinct[v[starts]] = total2, after2
        seen2[block.hot_rows] = bigram[block.bigram_of]
        own = np.flatnonzero(block.hot)
        if len(own):
            count[own] = hot_counts[np.searchsorted(hot_keys, block.hashes[own])]
            distinct[own] = common(block.hashes[own], None)[1]
        share2 = np.where(count > 0, DISCOUNT * distinct / np.maximum(count, 1), 1.0)
        as_word = count
        as_word[block.hashes == END] = n_docs
        p = (as_word + ADDED) / (n_tokens + ADDED * (n_words + 1))
        score = np.log10(seen3 + share3 * (seen2 + share2[block.v] * p[block.w]))[block.of_token]
        base, known = np.log10(p)[block.w][block.of_token], (as_word > 0)[block.w][block.of_token]
        total = lambda x: np.add.reduceat(x, block.first)
        out = pd.DataFrame(
            {
                "doc_id": pd.array(np.where(block.known, block.ids, 0), "Int64").copy() if block.known.all() else pd.array([int(i) if k else None for i, k in zip(block.ids, block.known, strict=True)], "Int64"),
                "held_out": block.held,
                "n_tokens": block.sizes,
                "n_known": total(known.astype(np.int64)),
                "train_tokens": n_tokens,
                "base_score": total(base),
                "score": total(score),
            }
        )
        del block, seen3, seen2, share3, score, base, known
        let_go()
        return out

    return run


def score_documents(docs: DataFrame, mod: int = 10) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Learns from the documents whose crc32(doc_id as text) mod `mod` isn't 0."""
    docs = texts_in_batches(docs.select(F.col("doc_id").cast("long"), "text"))
    fragments = max(2, math.ceil(input_bytes(docs) / BYTES_A_TOKEN / PER_FRAGMENT))
    blocks = stored(docs.mapInArrow(_blocks(mod), "block long, payload binary, train_tokens long, train_docs long, context long, n long"), "blocks")
    totals = blocks.agg(F.sum("train_tokens"), F.sum("train_docs")).first()
    n_tokens, n_docs = totals[0] or 0, totals[1] or 0
    top = blocks.where("context IS NOT NULL").groupBy("context").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, n_tokens // (2 * MOST_SHARE))).select("context").collect()
    chosen = np.array(sorted({r["context"] for r in top} | {int(START)}), np.uint64)
    streams = blocks.where("payload IS NOT NULL").select("block", "payload")

    def hot_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                body = parts(payload.as_py())
                hashes, counts = unpack(body[5]), unpack(body[6]).astype(np.int64)
                own = np.isin(hashes, chosen)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[own].view(np.int64)), pa.array(counts[own])], names=["context", "n"])

    exact = streams.select("payload").mapInArrow(hot_totals, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).collect()
    hot = {r["context"]: r["n"] for r in exact} | {int(START): n_docs}
    schema = "block long, fragment int, answer binary, n_new long, v long, u long, total long, n_after long"
    answers = None
    for k in range(ROUNDS):
        requests = streams.mapInArrow(_requests(np.array(sorted(hot), np.uint64), fragments, k), "block long, fragment int, payload binary")
        some = stored(requests.groupBy("fragment").applyInPandas(_answers(hot), schema), "answers")
        answers = some if answers is None else answers.unionByName(some)
    n_words = (answers.agg(F.sum("n_new")).first()[0] or 0) + sum(n > 0 for h, n in hot.items() if h != int(START)) + (n_docs > 0)
    found = answers.where("block IS NULL").groupBy("v", "u").agg(F.sum("total").alias("total"), F.sum("n_after").alias("n_after")).toPandas()
    contexts = tuple(found[c].to_numpy(np.int64) for c in ("v", "u", "total", "n_after"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = streams.groupBy("block").cogroup(answers.where("block IS NOT NULL").select("block", "fragment", "answer").groupBy("block"))
    return both.applyInPandas(_scores(hot, contexts, fragments, int(n_tokens), int(n_docs), int(n_words)), schema)
