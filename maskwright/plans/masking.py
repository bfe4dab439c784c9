"""The masking plan: detect, filter, resolve, propagate, merge, number, substitute, check; one narrow stage over a corpus."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import patterns as P
from ..operators import filters, glossary, spans as S
from ..operators.providers import reply_objects
from ..operators.review import apply_verdicts, beside_kept, candidates, judge_numbers, recall, same_text, snippet, verdicts
from ..rules import CORPORATE, DATES, DEFAULT, Rule

LONG_DIGITS, EMAIL_LIKE, ANY_PLACEHOLDER = re.compile(P.LONG_DIGITS), re.compile(P.EMAIL_LIKE), re.compile(P.PLACEHOLDER_ANY)


@dataclass(frozen=True)
class PipelineConfig:
    """Which layers run. Providers: functions from a text to spans (NER, chat models); leak_check: run again on the masked text.
    review and recall: functions from a prompt to a reply. number_after: numbers start after placeholders that the text already has."""

    regex: bool = True
    corporate: bool = True
    dates: bool = False
    terms: tuple[glossary.Term, ...] = field(default_factory=lambda: glossary.parse(glossary.DEFAULT_TERMS))
    providers: tuple[Callable[[str], list[S.Span]], ...] = ()
    leak_check: tuple[Callable[[str], list[S.Span]], ...] = ()
    review: Callable[[str], str] | None = None
    recall: Callable[[str], str] | None = None
    names: object | None = None
    everywhere: bool = True
    number_after: bool = False
    irreversible: bool = False

    def detectors(self) -> list[Rule | Callable[[str], list[S.Span]]]:
        out: list = [glossary.detector(self.terms)] if self.terms else []
        out += DEFAULT if self.regex else ()
        out += CORPORATE if self.regex and self.corporate else ()
        out += DATES if self.regex and self.dates else ()
        return [*out, *self.providers]


@dataclass
class Result:
    masked: str
    mapping: dict[str, str]
    spans: list[S.Span]
    preexisting: int
    warnings: list[dict]
    surfaces: dict[str, str] = field(default_factory=dict)  # surface form to placeholder

    @property
    def summary(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for s in self.spans:
            out[s.label] = out.get(s.label, 0) + 1
        return out


def residual(text: str) -> list[dict]:
    """What still looks like data once placeholders are blanked: long digit runs and addresses, each value once."""
    blank, seen, out = ANY_PLACEHOLDER.sub(lambda m: " " * len(m[0]), text), set(), []
    for kind, rx in (("DIGITS", LONG_DIGITS), ("EMAIL", EMAIL_LIKE)):
        for m in rx.finditer(blank):
            if (kind, value := m[0].strip()) not in seen:
                seen.add((kind, value))
                out.append({"kind": kind, "value": value, "context": " ".join(f"…{text[max(0, m.start() - 30) : m.end() + 30]}…".split())})
    return out


def leaked(text: str, spans: list[S.Span], placeholders: list[str], detectors: tuple) -> list[S.Span]:
    """What detectors still find in the masked text, at its places in the original. In order of the values, so that runs agree."""
    interim, _ = S.substitute(text, spans, placeholders)
    hidden = S.placeholder_ranges(interim)
    found = {(s.text, s.label) for d in detectors for s in d(interim) if not any(S.overlap((s.start, s.end), h) for h in hidden)}
    taken = S.Taken((s.start, s.end) for s in spans)
    return [S.Span(a, b, label, value, "llm2") for value, label in sorted(found) for a, b in S.occurrences(text, value) if taken.free(a, b)]


def yes_or_no(ask: Callable[[str], str], values: list[tuple[str, str]]) -> dict[str, bool]:
    """For (value, context) pairs: whether the reply says to mask each. Values that it doesn't echo have no answer."""
    out = {}
    for x in reply_objects(ask("\n".join(f"{k}. {value} : {context}" for k, (value, context) in enumerate(values)))):
        k = x.get("id")
        if isinstance(k, int) and 0 <= k < len(values) and same_text(str(x.get("text", "")), values[k][0]) and isinstance(x.get("mask"), bool):
            out[values[k][0]] = x["mask"]
    return out


def answered(ask: Callable[[str], str], text: str, spans: list[S.Span]) -> dict[str, bool]:
    """yes_or_no of the spans' values; no answers if the call fails."""
    try:
        return yes_or_no(ask, list({s.text: (s.text, snippet(text, s)) for s in spans}.values())) if spans else {}
    except Exception:  # noqa: BLE001 - no answer
        return {}


def mask(text: str, config: PipelineConfig, detectors: list | None = None) -> Result:
    protected = S.placeholder_ranges(text)
    warnings: list[dict] = []
    ok = lambda found: [s for s in found if filters.passes(s, protected, config.review is not None)]

    def aligned(s: S.Span) -> S.Span:
        start, end = S.balanced(text, s.start, s.end)
        return s if (start, end) == (s.start, s.end) or start >= end else s.moved(text, start, end)

    spans = S.resolve(ok(map(aligned, S.detect(text, config.detectors() if detectors is None else detectors))))
    for propagate in (S.aliases, S.case_forms):
        if more := ok(propagate(text, spans)):
            spans = S.resolve(spans + more)
    if config.leak_check:
        more = ok(map(aligned, leaked(text, spans, S.number(spans)[1], config.leak_check)))
        spans = S.resolve(spans + more) if more else spans
    if config.review:
        asked = candidates(text, spans)
        try:
            lines = "\n".join(f'{k}. [{c.label}] "{c.text}" : {c.context}' for k, c in enumerate(asked.values()))
            reply = config.review(lines) if asked else "[]"
            judged = S.resolve(apply_verdicts(text, spans, asked, verdicts(reply, list(asked.values())), config.names))
            gone = [s for s in spans if not any(s.start == k.start for k in judged)]
            answers = answered(config.review, text, beside := beside_kept(text, gone, judged))
            judged = S.resolve(judged + [s for s in beside if answers.get(s.text) is not False])
            spans = judge_numbers(text, judged, lambda values: yes_or_no(config.review, values))
        except Exception as error:  # noqa: BLE001 - a review that fails leaves everything masked
            warnings.append({"kind": "review_failed", "message": str(error)})
    if config.recall:
        more = ok(map(aligned, recall(text, spans, S.number(spans)[1], config.recall, warnings=warnings)))
        spans = S.resolve(spans + more) if more else spans
    spans = S.merge_forms([s for s in spans if not filters.is_generic(s)])
    first: dict[str, int] = {}
    if config.number_after:
        for label, n in S.PLACEHOLDER.findall(text):
            first[label] = max(first.get(label, 0), int(n))
    mapping, placeholders = S.number(spans, first)
    masked, replaced = S.substitute(text, spans, placeholders, config.everywhere)
    mapping = {k: v for k, v in mapping.items() if k in masked}
    surfaces: dict[str, str] = {}
    for s, p in zip(spans, placeholders, strict=True):
        surfaces.setdefault(s.text, p)
    return Result(masked, {} if config.irreversible else mapping, replaced, len(protected), residual(masked) + warnings, surfaces)


RESULT = (
    "masked string, mapping map<string,string>, spans array<struct<start:int,end:int,label:string,text:string,source:string>>, preexisting int, "
    "warnings array<struct<kind:string,value:string,context:string,offset:int,chars:int,message:string>>, summary map<string,int>"
)


def mask_documents(docs: DataFrame, config: PipelineConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, then the columns of RESULT, one row for each row of docs; null text stays null. A narrow stage: no shuffle, works on streams.
    irreversible: neither the mapping nor span texts are made."""
    from pyspark.sql.types import StructType

    config = config or PipelineConfig()
    schema = StructType([docs.schema[id_col], *StructType.fromDDL(RESULT).fields])
    arrow: list[pa.Schema] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not arrow:
            arrow.append(to_arrow_schema(schema))
        detectors = config.detectors()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = None if text is None else mask(text, config, detectors)
                rows.append({id_col: key} | {f.name: None for f in schema.fields[1:]} if r is None else {
                    id_col: key, "masked": r.masked, "mapping": list(r.mapping.items()), "preexisting": r.preexisting, "summary": list(r.summary.items()),
                    "spans": [{"start": s.start, "end": s.end, "label": s.label, "text": None if config.irreversible else s.text, "source": s.source} for s in r.spans],
                    "warnings": [{k: w.get(k) for k in ("kind", "value", "context", "offset", "chars", "message")} for w in r.warnings],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow[0])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def without_mapping(results: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What may leave the restricted area: masked text, counts, and the kinds of warnings."""
    return results.select(id_col, "masked", "summary", "preexisting", F.transform("warnings", lambda w: w["kind"]).alias("warning_kinds"))


def mapping_rows(results: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The restricted child table: one row for each placeholder."""
    return results.select(id_col, F.explode("mapping").alias("placeholder", "original")).select(
        id_col, "placeholder", F.regexp_extract("placeholder", P.PLACEHOLDER, 1).alias("label"), F.regexp_extract("placeholder", P.PLACEHOLDER, 2).cast("long").alias("number"), "original"
    )
