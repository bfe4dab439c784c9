"""Elias-Fano sequences and an n-gram trie of them, memory-mapped."""

from __future__ import annotations

import mmap

import numpy as np

ONE = np.uint64(1)
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: The place of the k-th set bit of each byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _places = [_i for _i in range(8) if _b >> _i & 1]
    _SELECT[_b, : len(_places)] = _places


class EliasFano:
    """A non-decreasing sequence of n integers below `universe`: the low bits of each packed, the high parts as the gaps
    between the ones of a bit vector. About 2 + log2(universe / n) bits for each, with select in constant steps.

    Arrays: low (packed bits), high (bytes), ones (the number of ones before each 64 bits of high)."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros: np.ndarray | None = None  # the number of zeros before each 64 bits of high, once asked for

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        values = values.astype(np.uint64)
        top = (values >> np.uint64(width)).astype(np.int64)
        size = n + (universe >> width) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_POPCOUNT[high].reshape(-1, 8).sum(1, dtype=np.int64))]).astype(np.int64)
        low = np.zeros(n * width // 8 + 16, np.uint8)
        for at in range(0, n if width else 0, 1 << 19):
            # A multiple of 8 values takes whole bytes.
            some = values[at : at + (1 << 19)]
            spread = ((some[:, None] >> np.arange(width, dtype=np.uint64)) & ONE).astype(np.uint8)
            packed = np.packbits(spread.reshape(-1), bitorder="little")
            low[at * width // 8 : at * width // 8 + len(packed)] = packed
        return cls(n, width, low, high, ones)

    def _select(self, k: np.ndarray, ones: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(ones, k, "right") - 1
        left = k - ones[word]
        own = self.high.view("<u8")[word]
        if flip:
            own = ~own
        at = word * 64
        for half in (32, 16, 8):  # the half of the rest that holds the bit
            low = np.bitwise_count(own & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left = left - low * up
            own = own >> (up * np.uint64(half))
            at += up * half
        return at + _SELECT[(own & np.uint64(0xFF)).astype(np.int64), left]

    def select1(self, k: np.ndarray) -> np.ndarray:
        return self._select(k, self.ones, False)

    def select0(self, k: np.ndarray) -> np.ndarray:
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        return self._select(k, self.zeros, True)

    def low_bits(self, k: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(k), np.uint64)
        at = k * self.width
        # Eight bytes from each byte on: one gather over a view whose rows overlap.
        whole = np.ndarray((len(self.low) - 7,), "<u8", self.low, 0, (1,))[at >> 3]
        return (whole >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def access(self, k: np.ndarray) -> np.ndarray:
        k = k.astype(np.int64)
        if not len(k):
            return np.zeros(0, np.uint64)
        return ((self.select1(k) - k).astype(np.uint64) << np.uint64(self.width)) | self.low_bits(k)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi) whose value is at least x; hi if there is none. The high part of x bounds the place by
        two selects; the rest is a search among values with the same high part."""
        x, lo, hi = x.astype(np.uint64), lo.astype(np.int64), hi.astype(np.int64)
        top = np.minimum((x >> np.uint64(self.width)).astype(np.int64), len(self.high) * 8 - self.n - 1)
        first = np.where(top > 0, self.select0(np.maximum(top - 1, 0)) - (top - 1), 0)
        last = self.select0(top) - top
        a, b = np.maximum(lo, first), np.minimum(hi, last)
        a = np.minimum(a, hi)
        b = np.maximum(a, b)
        want = x & np.uint64((1 << self.width) - 1)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self.low_bits(mid) < want[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        return a

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        (n, width), low, high, ones = arrays
        return cls(int(n), int(width), low, high, ones)


def quantised(values: np.ndarray, levels: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """Codes from 0 and the code book: bins of equal width, each standing for its values' mean. So no value moves by more than a
    bin's width, a 255th of the values' range."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    distinct = np.unique(values)
    if len(distinct) <= levels:
        return np.searchsorted(distinct, values).astype(np.uint8), distinct
    edges = np.linspace(distinct[0], distinct[-1], levels + 1)[1:-1]
    codes = np.searchsorted(edges, values, "left")
    n = np.bincount(codes, minlength=len(edges) + 1)
    book = np.bincount(codes, values, len(edges) + 1) / np.maximum(n, 1)
    return codes.astype(np.uint8), book


class Level:
    """The children of each place of the level above: pointers (Elias-Fano) to where each one's start, and their keys, each raised by the
    last raised key before its parent's own, so that the whole level is one monotone sequence (Elias-Fano). A child is found by
    successor search in its parent's range, for its key relative to that base. Beside the keys may stand one-byte codes of log10
    probabilities, and their code book."""

    def __init__(self, pointers: EliasFano, keys: EliasFano, codes: np.ndarray, book: np.ndarray):
        self.pointers, self.keys, self.codes, self.book = pointers, keys, codes, book

    @classmethod
    def build(cls, n_children: np.ndarray, children: np.ndarray, log_probability: np.ndarray | None = None) -> Level:
        """children: each parent's keys, sorted and distinct, in the parents' order."""
        starts = np.concatenate([[0], np.cumsum(n_children)]).astype(np.int64)
        own_last = np.zeros(len(n_children), np.int64)
        some = n_children > 0
        own_last[some] = children[starts[1:][some] - 1].astype(np.int64) + 1
        base = np.cumsum(own_last) - own_last
        raised = children + np.repeat(base, n_children)
        codes, book = quantised(log_probability) if log_probability is not None else (np.zeros(0, np.uint8), np.zeros(0))
        return cls(EliasFano.build(starts, int(starts[-1]) + 1), EliasFano.build(raised, int(own_last.sum()) + 1), codes, book)

    def range_of(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.pointers.access(parent).astype(np.int64), self.pointers.access(parent + 1).astype(np.int64)

    def find(self, parent: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The place of each (place of the parent, key); -1 where there is none, or the parent or the key is -1."""
        out = np.full(len(parent), -1, np.int64)
        for at in range(0, len(parent), 1 << 18):
            own = np.flatnonzero((parent[at : at + (1 << 18)] >= 0) & (key[at : at + (1 << 18)] >= 0)) + at
            if not len(own):
                continue
            # Once for each run of one parent.
            parents = parent[own]
            runs = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
            lo, hi = self.range_of(parents[runs])
            base = np.zeros(len(runs), np.uint64)
            some = np.flatnonzero((lo > 0) & (lo < hi))
            base[some] = self.keys.access(lo[some] - 1) + ONE
            each = np.diff(runs, append=len(own))
            lo, hi, base = np.repeat(lo, each), np.repeat(hi, each), np.repeat(base, each)
            some = lo < hi
            own, lo, hi, base = own[some], lo[some], hi[some], base[some]
            want = base + key[own].astype(np.uint64)
            place = self.keys.successor(want, lo, hi)
            ok = place < hi
            ok[ok] = self.keys.access(place[ok]) == want[ok]
            out[own[ok]] = place[ok]
        return out

    def code(self, place: np.ndarray) -> np.ndarray:
        """The codes at places, plus 1; 0 for place -1."""
        out = np.zeros(len(place), np.uint8)
        out[place >= 0] = self.codes[place[place >= 0]] + 1
        return out

    def arrays(self) -> list[np.ndarray]:
        return [*self.pointers.arrays(), *self.keys.arrays(), self.codes, self.book]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Level:
        return cls(EliasFano.of(arrays[:4]), EliasFano.of(arrays[4:8]), arrays[8], np.array(arrays[9]))


class NGramTrie:
    """N-grams u v w up to order 3, ordered by their middle word, in one memory-mapped image.

    words: the keys of all v (Elias-Fano). after (a level below words): the words w that follow each v, with codes of the bigrams v w.
    before (a level below words): the words u that precede v. tri (a level below before): the words w that follow u v, each written as its
    number among all words that follow v (the context u v is searched relative to its shorter context v, whose followers are few),
    with codes of the trigrams. The image can be written to a file and mapped from it."""

    def __init__(self, image: np.ndarray):
        self.image = image
        (n,) = np.frombuffer(image[:8], np.int64)
        head = np.frombuffer(image[8 : 8 + 24 * int(n)], np.int64).reshape(-1, 3)
        kinds = (np.uint8, np.int64, np.float64)
        mapped = [image[at : at + size].view(kinds[kind]) for at, size, kind in head.tolist()]
        self.words = EliasFano.of(mapped[:4])
        self.after, self.before, self.tri = (Level.of(mapped[4 + 10 * k : 14 + 10 * k]) for k in range(3))

    @classmethod
    def build(cls, words: np.ndarray, universe: int, after: Level, before: Level, tri: Level) -> NGramTrie:
        arrays = [*EliasFano.build(words, universe).arrays(), *after.arrays(), *before.arrays(), *tri.arrays()]
        raws = [np.ascontiguousarray(a) for a in arrays]
        at, head = 8 + 24 * len(raws), []
        for a in raws:
            head.append((at, a.nbytes, 0 if a.dtype == np.uint8 else 1 if a.dtype == np.int64 else 2))
            at += a.nbytes + -a.nbytes % 8
        image = np.frombuffer(mmap.mmap(-1, at), np.uint8)  # a map of its own, without a file: nothing is left behind when a task dies
        image[:8] = np.array([len(raws)], np.int64).view(np.uint8)
        image[8 : 8 + 24 * len(raws)] = np.array(head, np.int64).view(np.uint8).reshape(-1)
        for (start, size, _), a in zip(head, raws, strict=True):
            image[start : start + size] = a.view(np.uint8).reshape(-1)
        return cls(image)

    def save(self, path: str) -> None:
        self.image.tofile(path)

    @classmethod
    def open(cls, path: str) -> NGramTrie:
        return cls(np.memmap(path, np.uint8, "r"))

    def find_word(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in `words`, or -1."""
        n = self.words.n
        if not n:
            return np.full(len(keys), -1, np.int64)
        at = self.words.successor(keys, np.zeros(len(keys), np.int64), np.full(len(keys), n))
        ok = at < n
        ok[ok] = self.words.access(at[ok]) == keys[ok]
        return np.where(ok, at, -1)

    def find(self, v: np.ndarray, u: np.ndarray, pair: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes plus 1, or 0, of the bigrams v w and the trigrams u v w. v: places in `words`; u: keys of the different contexts, with
        `pair` the number of each n-gram's context (place of v and key of u); w: keys."""
        first = np.zeros(len(u), np.int64)
        first[pair] = v  # the context's v
        context = self.before.find(first, u)
        place = self.after.find(v, w)
        some = np.flatnonzero(place >= 0)
        runs = np.flatnonzero(np.concatenate([[True], v[some][1:] != v[some][:-1]])) if len(some) else some
        relative = place.copy()
        relative[some] -= np.repeat(self.after.pointers.access(v[some][runs]).astype(np.int64), np.diff(runs, append=len(some)))
        return self.after.code(place), self.tri.code(self.tri.find(context[pair], relative))
