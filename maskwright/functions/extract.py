"""Offset-exact pattern extraction and placeholder substitution as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import patterns as P
from ..rules import Rule

#: Private-use characters that mark matches in a scanned copy of the text; in the copy the text's own ones are replaced.
MARK, INNER, OTHER = chr(0xE000), chr(0xE001), chr(0xFFFD)


def pieces(text: Column, pattern: str, group: bool = False) -> Column:
    """gap, match, gap, match, ..., gap. Time is linear in the text (regexp_extract_all copies the whole text for each match).
    group: a match is followed by INNER and its group 1."""
    copy = F.translate(text, MARK + INNER, OTHER * 2)
    return F.split(F.regexp_replace(copy, pattern, f"{MARK}$0{INNER + '$1' if group else ''}{MARK}"), MARK)


def spans(text: Column, rule: Rule) -> Column:
    """The rule's spans, trimmed: array of start, end, label, text, source (end exclusive, code points). Rules of one group at most."""
    grouped = rule.anchor != "W"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        whole = F.split_part(part, F.lit(INNER), F.lit(1)) if grouped else part
        value = F.split_part(part, F.lit(INNER), F.lit(2)) if grouped else part
        end = acc["at"] + F.length(whole)
        start = {"W": acc["at"], "H": acc["at"], "T": end - F.length(value), "P": end - 1 - F.length(value)}[rule.anchor]
        lead = F.length(value) - F.length(F.ltrim(value, F.lit(rule.strip))) if rule.strip else F.lit(0)
        size = F.length(F.trim(value, F.lit(rule.strip))) if rule.strip else F.length(value)
        place = F.struct((start + lead).cast("int").alias("start"), (start + lead + size).cast("int").alias("end"))
        out = F.when((acc["k"] % 2 == 1) & (size > 0), F.array_append(acc["out"], place)).otherwise(acc["out"])
        return F.struct(end.cast("int").alias("at"), (acc["k"] + 1).alias("k"), out.alias("out"))

    found = F.aggregate(pieces(text, rule.java, grouped), zero, step)["out"]
    full = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rule.label).alias("label"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), F.lit(rule.source).alias("source")))
    empty = F.array().cast("array<struct<start:int,end:int,label:string,text:string,source:string>>")
    return F.when(text.rlike(rule.java), full).otherwise(empty)


def resolved(found: Column) -> Column:
    """Greedy choice among overlapping spans: weight of the label, length, start, then their order in the array."""
    weight = F.create_map(*[x for k, v in P.PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    ranked = F.array_sort(
        F.transform(found, lambda s, i: F.struct((-F.coalesce(F.try_element_at(weight, s["label"]), F.lit(0))).alias("w"), (s["start"] - s["end"]).alias("l"), s["start"].alias("a"), i.alias("i"), s.alias("s")))
    )
    take = lambda acc, x: F.when(F.exists(acc, lambda o: (o["s"]["start"] < x["s"]["end"]) & (x["s"]["start"] < o["s"]["end"])), acc).otherwise(F.array_append(acc, x))
    kept = F.transform(F.aggregate(ranked, F.slice(ranked, 1, 0), take), lambda x: x["s"])
    return F.array_sort(kept)


def keys(values: Column) -> Column:
    """The keys by which surface forms are one entity: white space collapsed, case folded."""
    return F.transform(values, lambda v: F.replace(F.lower(F.trim(F.regexp_replace(v, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss")))


def masked_by(text: Column, rule: Rule) -> Column:
    """The text with each match of a whole-match rule replaced by [LABEL_n], n by first appearance of its key."""
    parts = pieces(text, rule.java)
    values = F.filter(parts, lambda p, i: i % 2 == 1)
    order = F.array_distinct(keys(values))
    one = lambda p: F.concat(F.lit(f"[{rule.label}_"), F.array_position(order, F.element_at(keys(F.array(p)), 1)).cast("string"), F.lit("]"))
    return F.when(text.rlike(rule.java), F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, one(p)).otherwise(p)), "")).otherwise(text)


def restored(masked: Column, mapping: Column) -> Column:
    """One pass over the placeholders; those that the mapping lacks stay."""
    parts = pieces(masked, P.PLACEHOLDER)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(mapping, p), p)).otherwise(p)), "")


def unknown_placeholders(masked: Column, mapping: Column) -> Column:
    found = F.filter(pieces(masked, P.PLACEHOLDER), lambda p, i: i % 2 == 1)
    return F.array_except(found, F.map_keys(mapping))


def is_placeholder(value: Column) -> Column:
    return value.rlike(f"^{P.PLACEHOLDER}$")


def restored_strict(masked: Column, mapping: Column) -> Column:
    """restored(), or an error if the restored text holds a placeholder that the mapping lacks."""
    out = restored(masked, mapping)
    left = unknown_placeholders(out, mapping)
    return F.when(F.size(left) == 0, out).otherwise(F.raise_error(F.concat(F.lit("unresolved placeholders: "), F.array_join(left, ", "))))


def partly_restored(masked: Column, mapping: Column, keep: Column) -> Column:
    """Restores only the placeholders in `keep`."""
    return restored(masked, F.map_filter(mapping, lambda k, v: F.array_contains(keep, k)))


def residual(text: Column) -> Column:
    """What still looks like data: array of kind and value, each once. Placeholders are blanked."""
    blank = F.array_join(F.transform(pieces(text, "(?U)" + P.PLACEHOLDER_ANY), lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")

    def of(kind: str, pattern: str) -> Column:
        values = F.filter(pieces(blank, "(?U)" + pattern), lambda p, i: i % 2 == 1)
        return F.transform(F.array_distinct(F.transform(values, lambda v: F.trim(v))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(of("DIGITS", P.LONG_DIGITS), of("EMAIL", P.EMAIL_LIKE))


#: Signs of a leak in masked text.
SNIFFERS = {
    "capitals": r"\b[А-ЯЁ][а-яё]{2,}\s+[А-ЯЁ][а-яё]{2,}\b",
    "digits": r"\d{6,}",
    "email": r"\S+@\S+\.\S+",
    "requisite": r"(?i)(?:инн|кпп|бик|огрн|р/с|к/с)\D{0,10}\d+",
    "money": r"(?i)\d[\d\s]*(?:руб|₽|тыс|млн)",
}


def sniffed(text: Column) -> Column:
    """By kind: the sorted distinct suspicious values."""
    found = lambda p: F.array_sort(F.array_distinct(F.filter(pieces(text, "(?U)" + p), lambda x, i: i % 2 == 1)))
    return F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("kind"), found(p).alias("values")) for k, p in SNIFFERS.items()]))


def mapping_json(mapping: Column) -> Column:
    return F.to_json(mapping)


def mapping_from_json(text: Column) -> Column:
    """The mapping of a JSON object of strings; null for anything else."""
    return F.from_json(text, "map<string,string>")
