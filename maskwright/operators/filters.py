"""Which spans are no entities: predicates on a span's text and label."""

from __future__ import annotations

import re

from .. import patterns as P
from .spans import Span

WORDS = re.compile(r"[A-Za-zА-Яа-яЁё]+")
TIMECODE = re.compile(P.TIMECODE)
SPEAKER = re.compile(P.SPEAKER, re.IGNORECASE)
REPEATED = re.compile(P.REPEATED, re.IGNORECASE)
FUNCTION_WORDS = P.STOPWORDS | P.PREPOSITIONS | P.INTERJECTIONS


def starts(word: str, stems: list[str]) -> bool:
    return word.startswith(tuple(stems))


def has_alnum(text: str) -> bool:
    return any(c.isalnum() for c in text)


def is_short_number(text: str) -> bool:
    return text.strip().isdigit() and len(text.strip()) in (2, 3)


def is_contract_role(text: str) -> bool:
    words = WORDS.findall(text.lower())
    return bool(words) and all(starts(w, P.CONTRACT_ROLE_STEMS) for w in words)


def is_software(text: str) -> bool:
    return any(m in text.strip().lower() for m in P.SOFTWARE)


def is_job_title(text: str) -> bool:
    low = text.strip().lower()
    words = WORDS.findall(low)
    return low in P.GENERIC_TITLES or bool(words) and all(starts(w, P.ROLE_STEMS + P.MODIFIER_STEMS) for w in words) and any(starts(w, P.ROLE_STEMS) for w in words)


def is_stopword(text: str, label: str) -> bool:
    low = " ".join(text.split()).casefold()
    return label in P.SOFT_LABELS and (len(low) <= 1 or low in P.REQUISITE_WORDS or low in P.STOPWORDS)


def is_money(text: str) -> bool:
    low = text.lower()
    return "%" in low and "годов" in low or any(c in low for c in P.MONEY_CUES)


def is_common_phrase(text: str, label: str) -> bool:
    """An organisation or place without a quotation mark and without a capital."""
    return label in P.MERGED_LABELS and not any(c in "«»\"" or c.isupper() for c in text.strip())


def is_noise(text: str, label: str) -> bool:
    s = text.strip()
    if len(s) < 2 or TIMECODE.fullmatch(s):
        return True
    if label != "PERSON" and label not in P.PLACE_LABELS:
        return False
    words = WORDS.findall(s.lower())
    if SPEAKER.fullmatch(s) or is_contract_role(s):
        return True
    if label == "PERSON":
        return bool(
            REPEATED.fullmatch(s)
            or not s[0].isupper()
            or len(words) >= 4
            or words and all(w in FUNCTION_WORDS for w in words)
            or len(words) == 1 and words[0] in P.COMMON_NOUNS
        )
    return s.lower() in P.COMMON_NOUNS or bool(words) and all(w in FUNCTION_WORDS or starts(w, P.NOISE_STEMS) for w in words)


def is_generic(span: Span) -> bool:
    """A person, organisation or place named by generic words alone."""
    if span.label not in P.CASE_LABELS:
        return False
    words = span.text.strip().strip("«»\"'()[].,;:!?—–-").lower().replace("ё", "е").split()
    return all(any(w == g or len(w) > 4 and w.startswith(g[:5]) for g in P.GENERIC_ENTITIES) for w in words)


def passes(span: Span, protected: list[tuple[int, int]], reviewed: bool = False) -> bool:
    """reviewed: a later layer judges short numbers, so they stay."""
    t, label = span.text, span.label
    return (
        has_alnum(t)
        and (reviewed or not is_short_number(t))
        and not (label in P.SOFT_LABELS and (is_job_title(t) or is_software(t)))
        and not is_stopword(t, label)
        and not is_noise(t, label)
        and not is_common_phrase(t, label)
        and (label != "AMOUNT" or span.source == "price_kw" or is_money(t))
        and not any(span.start < e and s < span.end for s, e in protected)
    )
