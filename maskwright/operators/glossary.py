"""Terms that are always masked: `alias, alias = canonical name`, one entry on a line."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .. import patterns as P
from .spans import WORD, Span

#: The entries that apply unless others are given.
DEFAULT_TERMS = """
Мингос = Министерство государственного управления
Минфин = Министерство финансов
Правительство = Правительство
"""


@dataclass(frozen=True)
class Term:
    canonical: str
    aliases: tuple[str, ...]
    label: str = "CUSTOM_TERM"


def parse(text: str) -> tuple[Term, ...]:
    """Lines without `=` or without an alias are skipped; # starts a comment; without a canonical name the first alias is it."""
    out = []
    for line in text.splitlines():
        left, equals, right = line.split("#", 1)[0].partition("=")
        names = tuple(n.strip() for n in left.split(",") if n.strip())
        if equals and names:
            out.append(Term(right.strip() or names[0], names))
    return tuple(out)


def load(spark: SparkSession, path: str) -> tuple[Term, ...]:
    """From a text file on any file system; none if there is no such file. A glossary is small and goes to the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return ()
    return parse("\n".join(r.value for r in spark.read.text(path).collect()))


def alias_pattern(alias: str) -> re.Pattern:
    """The alias in any case: without the vowel that the nominative ends in, and with any case ending."""
    stem, own = (alias[:-1], alias[-1]) if alias[-1:].casefold() in tuple("аяоеё") and len(alias) >= 4 else (alias, "")
    endings = sorted({*P.CASE_ENDINGS, *([own] if own else [])}, key=lambda e: (-len(e), e))
    return re.compile(f"(?<![{WORD}]){re.escape(stem)}(?:{'|'.join(map(re.escape, endings))})?(?![{WORD}])", re.IGNORECASE)


def detector(terms: tuple[Term, ...]) -> Callable[[str], list[Span]]:
    compiled = [(alias_pattern(a), t, f"CUSTOM_TERM\0{t.canonical.casefold()}") for t in terms for a in t.aliases]
    return lambda text: [Span(*m.span(), t.label, m[0], "glossary", key, t.canonical) for rx, t, key in compiled for m in rx.finditer(text)]
