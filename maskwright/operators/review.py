"""A model's second look: candidates, verdicts, merges, and what it missed."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from .. import patterns as P
from .chunking import chunks
from .providers import NameDictionary, recall_label, reply_objects
from .spans import Span, Taken, case_stem, occurrences, substitute

CONTEXT, NUMBER_CONTEXT, MOST_OCCURRENCES, LEAST_RECALL = 60, 90, 40, 3


@dataclass(frozen=True)
class Candidate:
    label: str
    text: str
    context: str


def key_of(s: Span) -> str:
    return f"{s.label}\0{' '.join(s.text.split()).casefold()}"


def snippet(text: str, s: Span, width: int = CONTEXT) -> str:
    return " ".join(f"{text[max(0, s.start - width) : s.start]}[{s.text}]{text[s.end : s.end + width]}".split())


def candidates(text: str, spans: list[Span]) -> dict[str, Candidate]:
    """Values to judge: those of models, and administrative codes. Contexts of the first, middle and last occurrence."""
    groups: dict[str, list[Span]] = {}
    for s in spans:
        if s.label in P.REVIEWABLE_LABELS and (s.source in P.MODEL_SOURCES or s.label == "ADMIN_CODE"):
            groups.setdefault(key_of(s), []).append(s)
    out = {}
    for key, own in groups.items():
        some = own if len(own) <= 3 else [own[0], own[(len(own) - 1) // 2], own[-1]]
        out[key] = Candidate(own[0].label, own[0].text, " | ".join(dict.fromkeys(snippet(text, s) for s in some)))
    return out


def same_text(a: str, b: str) -> bool:
    return " ".join(a.split()).casefold() == " ".join(b.split()).casefold()


VOWELS = set("аеёиоуыэюя")


def impossible_name(word: str) -> bool:
    """No part between hyphens can be a name by its shape."""

    def odd(part: str) -> bool:
        low = part.lower()
        return (
            not 3 <= len(part) < 25
            or any(not ("а" <= c <= "я" or c == "ё") for c in low)
            or re.search(r"(.)\1\1", low) is not None
            or not VOWELS & set(low)
            or part.isupper() and len(part) == 3
        )

    return all(odd(p) for p in word.split("-") if p)


def may_unmask(value: str, names: NameDictionary | None) -> bool:
    """Each capitalised Cyrillic word is known and no name, or can't be a name. Without a dictionary: never."""
    words = [w for raw in value.split() if re.match("[А-ЯЁ]", w := raw.strip("«»\"'(),.;:!?"))]
    return names is not None and all(names.is_known(w) and not names.is_name(w) or impossible_name(w) for w in words)


def verdicts(reply: str, asked: list[Candidate]) -> dict[int, dict]:
    """By candidate: objects whose id is in range and whose text echoes the candidate's."""
    out = {}
    for x in reply_objects(reply):
        k = x.get("id")
        if isinstance(k, int) and not isinstance(k, bool) and 0 <= k < len(asked) and isinstance(x.get("text"), str) and same_text(x["text"], asked[k].text):
            out[k] = x
    return out


def apply_verdicts(text: str, spans: list[Span], asked: dict[str, Candidate], replies: dict[int, dict], names: NameDictionary | None) -> list[Span]:
    """Drops, trims and merges candidates as the replies say; what they don't mention stays. Case forms and aliases of a dropped
    candidate go with it."""
    keys, own = list(asked), list(asked.values())
    dropped = {k for k, x in replies.items() if x.get("keep") is False and (own[k].label != "PERSON" or may_unmask(own[k].text, names))}
    trims = {k: x["trim"] for k, x in replies.items() if k not in dropped and isinstance(x.get("trim"), str) and x["trim"] and x["trim"] != own[k].text and x["trim"] in own[k].text}
    parent = {}
    for k, x in replies.items():
        other = x.get("merge_with")
        if k not in dropped and isinstance(other, int) and not isinstance(other, bool) and 0 <= other < len(own) and other != k and other not in dropped:
            if own[k].label == own[other].label or {own[k].label, own[other].label} == {"PERSON", "ORG"}:
                parent[k] = other

    def root(k: int) -> int:
        seen = set()
        while k in parent and k not in seen:
            seen.add(k)
            k = parent[k]
        return min(seen) if k in seen else k

    roots = {k: root(k) for k in {*parent, *parent.values()}}
    stems = [(own[k].label, (case_stem(own[k].text) or own[k].text).casefold()) for k in dropped]
    place = {key: k for k, key in enumerate(keys)}
    out = []
    for s in spans:
        k = place.get(key_of(s)) if s.source in P.MODEL_SOURCES or s.label == "ADMIN_CODE" else None
        if k in dropped or s.source in ("morph", "alias") and any(s.label == label and s.text.casefold().startswith(stem) for label, stem in stems):
            continue
        if k in trims:
            at = s.text.find(trims[k])
            s = s.moved(text, s.start + at, s.start + at + len(trims[k])) if at >= 0 else s
        if k in roots:
            s = replace(s, merge_key=f"REVIEW\0{roots[k]}", canonical=own[roots[k]].text)
        out.append(s)
    return out


def judge_numbers(text: str, spans: list[Span], ask: Callable[[list[tuple[str, str]]], dict[str, bool]]) -> list[Span]:
    """Bare numbers of two or three digits: masked only if the answer says so. Each value is asked for once."""
    short = {s.text: snippet(text, s, NUMBER_CONTEXT) for s in reversed(spans) if s.text.strip().isdigit() and len(s.text.strip()) in (2, 3)}
    try:
        keep = ask(sorted(short.items())) if short else {}
    except Exception:  # noqa: BLE001 - no answer means unmask
        keep = {}
    return [s for s in spans if s.text not in short or keep.get(s.text) is True]


def beside_kept(text: str, dropped: list[Span], kept: list[Span], gap: int = 3) -> list[Span]:
    """Dropped persons within `gap` separators of a kept one: they are asked for again, and stay masked without an answer."""
    persons = [k for k in kept if k.label == "PERSON"]
    between = lambda a, b: text[a.end : b.start] if a.end <= b.start else None
    close = lambda t: t is not None and len(t) <= gap and not any(c.isalnum() for c in t)
    return [d for d in dropped if d.label == "PERSON" and any(close(between(d, k)) or close(between(k, d)) for k in persons)]


def recall(text: str, spans: list[Span], placeholders: list[str], ask: Callable[[str], str], max_chars: int = 12_000, keep_unknown: bool = False, warnings: list[dict] | None = None) -> list[Span]:
    """Shows a model the masked text and places the values it still finds; unknown types are dropped or become SENSITIVE."""
    interim, _ = substitute(text, spans, placeholders, everywhere=False)
    wanted: dict[tuple[str, str], str] = {}
    failed = 0
    parts = chunks(interim, max_chars)
    for _, part in parts:
        try:
            reply = ask(part)
        except Exception:  # noqa: BLE001
            failed += 1
            continue
        for x in reply_objects(reply):
            value, kind = x.get("text"), x.get("type")
            if not (isinstance(value, str) and isinstance(kind, str) and len(value.strip()) >= LEAST_RECALL) or re.search(P.PLACEHOLDER, value):
                continue
            label = recall_label(kind)
            if label in P.RECALL_LABELS or keep_unknown:
                wanted.setdefault((value.strip(), label), label if label in P.RECALL_LABELS else "SENSITIVE")
    if failed and warnings is not None:
        warnings.append({"kind": "recall_failed" if failed == len(parts) else "recall_partial", "message": f"{failed} of {len(parts)} parts failed"})
    taken, out = Taken((s.start, s.end) for s in spans), []
    for (value, _), label in wanted.items():
        places = occurrences(text, value)
        for a, b in places if len(places) <= MOST_OCCURRENCES else []:
            if taken.free(a, b):
                taken.add(a, b)
                out.append(Span(a, b, label, value, "llm-recall"))
    return out
