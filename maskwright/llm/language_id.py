"""Language identification with bit-sliced Bloom filters of character 3-grams.

One table holds all languages' filters: row r is a bitmask of the languages whose filter has bit r.
K hash functions pick K rows for an n-gram; their AND is the set of languages that (may) contain it.
For each document the languages' counts are summed (a popcount for each language), corrected for the
filter's false positives, and the largest decides.

Rows: null text and text without a letter give `und` with score 0; a document of which no n-gram is known
gives the first language with score 0; ties go to the first language in alphabetical order. With nothing
to learn from (empty table, no language) every row gives `und`. Repeated rows and null ids each
give a row. Texts may be of any length: each is taken whole, and time is linear in it. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, let_go, remainder, texts_in_batches

N = 3
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: The fit's documented bounds: documents of each language, and the least share of a language's n-grams
#: that one must have (so at most 1 / LEAST_SHARE n-grams of a language reach the driver).
SAMPLE_DOCS, LEAST_SHARE = 600, 3e-5
#: An n-gram joins a language's filter if its share there is at least this part of its largest share anywhere.
PART_OF_LARGEST = 0.2
CHARS_AT_ONCE = 1 << 18


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of the texts, and each one's text. Every run of other characters than letters
    counts as one space; none reaches over two texts."""
    texts = [t.lower() for t in texts]
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    letter = letters()[code]
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | before
    code, owner = np.where(letter, code, np.uint64(32))[keep], owner[keep]
    if len(code) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = code[: 1 - N].copy()
    for k in range(1, N):
        out = (out << np.uint64(21)) | code[k : len(code) - N + 1 + k]
    whole = owner[: 1 - N] == owner[N - 1 :]
    return out[whole], owner[: 1 - N][whole]


def in_groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The texts, null as empty, in groups of about CHARS_AT_ONCE characters."""
    start, group, size = 0, [], 0
    for i, t in enumerate(texts):
        group.append(t or "")
        size += len(group[-1])
        if size > CHARS_AT_ONCE:
            yield start, group
            start, group, size = i + 1, [], 0
    if group:
        yield start, group


@dataclass
class LanguageFilters:
    """langs: sorted names; slices: for each 64 of them a table of bitmasks; false_positive: a rate for each."""

    langs: list[str]
    slices: list[np.ndarray]
    false_positive: np.ndarray

    @staticmethod
    def rows(codes: np.ndarray, bits: int) -> list[np.ndarray]:
        return [(((codes ^ (codes >> np.uint64(29))) * np.uint64(h)) >> np.uint64(64 - bits)).astype(np.int64) for h in HASHES]

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> LanguageFilters:
        langs = sorted(members)
        bits = max(10, int(np.ceil(np.log2(8 * max((len(v) for v in members.values()), default=1) + 1))))
        slices, rates = [], []
        for at in range(0, len(langs), 64):
            some = langs[at : at + 64]
            kind = np.uint8 if len(some) <= 8 else np.uint64
            rows = np.zeros(1 << bits, kind)
            for b, lang in enumerate(some):
                own = np.zeros(1 << bits, bool)
                for r in cls.rows(members[lang].astype(np.uint64), bits):
                    own[r] = True
                rows |= own.astype(kind) << kind(b)
                rates.append(own.mean() ** len(HASHES))
            slices.append(rows)
        return cls(langs, slices, np.array(rates))

    def contain(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each slice, the bitmask of languages that contain each n-gram."""
        out = []
        for table in self.slices:
            rows = self.rows(codes, int(len(table)).bit_length() - 1)
            mask = table[rows[0]]
            for r in rows[1:]:
                mask &= table[r]
            out.append(mask)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        import regex

        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        codes, owner = grams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        counts = np.zeros((len(texts), len(self.langs)))
        for at, mask in enumerate(self.contain(codes)):
            for b in range(min(64, len(self.langs) - 64 * at)):
                counts[:, 64 * at + b] = np.bincount(owner, (mask >> mask.dtype.type(b)) & mask.dtype.type(1), len(texts))
        fixed = np.clip((counts - total[:, None] * self.false_positive) / (1 - np.minimum(self.false_positive, 0.99)), 0, None)
        best = fixed.argmax(1)
        score = np.clip(fixed[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        has_letter = [regex.search(r"\p{L}", t) is not None for t in texts]
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has_letter, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(score, has_letter, strict=True)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for _, group in in_groups([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                code, n = np.unique(grams(group)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageFilters:
    """Learns from about sample_docs rows of each language (all, where there are fewer), picked by a hash of
    doc_id. docs: doc_id, text, lang; rows without lang or text teach nothing."""
    texts_in_batches(docs)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageFilters([], [], np.zeros(0))
    rate = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))]), F.col("lang"))
    picked = rows.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("sample")), F.lit(1_000_000)) < rate * 1_000_000)
    counts = picked.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    common = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= LEAST_SHARE * F.col("total")).select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    found = common.toPandas()
    largest = found.groupby("gram")["share"].transform("max")
    found = found[found["share"] >= PART_OF_LARGEST * largest]
    return LanguageFilters.build({lang: found.loc[found["lang"] == lang, "gram"].to_numpy(np.uint64) for lang in sizes})


def predict(docs: DataFrame, model: LanguageFilters, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs, then the predicted language and its score, called `names`."""
    spark = texts_in_batches(docs).sparkSession
    sent = spark.sparkContext.broadcast(model)  # 2^bits rows: bounded by 1 / LEAST_SHARE
    own = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    at_text = own.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id")
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                for at, group in in_groups(some.column(at_text).to_pylist()):
                    lang, score = sent.value.predict(group)
                    rest = [c.slice(at, len(group)) for c in some.columns[: len(keep)]]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])
        let_go()

    return own.mapInArrow(run, schema)


def fit_and_predict(docs: DataFrame, mod: int = 4, held_out: int = 2) -> DataFrame:
    """Learns from the documents whose crc32(doc_id as text) mod `mod` isn't `held_out` (a null id teaches
    nothing), and predicts all: doc_id, held_out, lang_pred, score."""
    split = docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), mod) == held_out, F.lit(False)))
    return predict(split, fit(split.where(~F.col("held_out") & F.col("doc_id").isNotNull())), ["doc_id", "held_out"])
