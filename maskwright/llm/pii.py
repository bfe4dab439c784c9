"""Personal data: base patterns, and a semi-Markov conditional random field that adds the spans they miss.

A segmentation cuts a zone of text into segments: single tokens of no kind, or entities of at most MAX_TOKENS
tokens. Its score sums, for each entity segment, the weights of features of the whole span (its digits, grouping,
checksum, cue words before it) and, for neighbouring segments, a transition weight. Training raises the conditional
log-likelihood of labelled segmentations (forward-backward over segments); decoding is the best segmentation
(Viterbi over segments, entities bounded in length), which settles boundaries and kinds together. Spans of
the base patterns are clamped: they stay, and no other segment may touch them.

A segment that `plausible` refuses scores minus infinity, so only zones around a possible entity are decoded: other text can
only be of no kind. Beside the base patterns' four kinds the field knows a fifth, `secret` (keys, tokens and passwords in
assignments). Entities have at most MAX_TOKENS tokens and MAX_CHARS characters: the bound of the dynamic programming.

The weights stand in pii_weights.json: `python -m maskwright.llm.pii` learns them anew from training_text(), with fixed seeds.

Rows: null text is empty and has no spans; repeated rows and null ids each give a row; empty tables give none. Spans that
overlap each other all count (base patterns of different kinds may); ties between segmentations go to the earlier kind and the
shorter last segment. Texts may be of any length: time is linear in it. Offsets are code points, end exclusive. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import pkgutil
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_in_batches

KINDS = ("email", "ip", "card", "phone", "secret")
N_BASE = 4
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
Span = tuple[int, int, int]  # start, index into KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def digits_of(s: str) -> str:
    return "".join(GROUPS.findall(s))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail their check are dropped. In time linear in the text."""
    out: list[Span] = []
    before, at = 0, text.find("@")
    while at >= 0:
        local = text[before:at]
        start = at - (len(local) - len(local.rstrip(LOCAL)))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
        before = found.end() if found else at + 1
        at = text.find("@", before)
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


# --- the semi-Markov conditional random field -------------------------------------------------------------

MAX_TOKENS, MAX_CHARS = 14, 120
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
#: Where a zone may be: at least seven digits with up to three separators between, four numbers with dots, words for @ and dot, or long mixed runs.
NUMBERS = re.compile(r"[0-9](?:[\s().\[\]/,_+-]{0,3}[0-9]){6,}|[0-9]{1,3}(?:\s?[\[(]?(?:\.|dot)[\])]?\s?[0-9]{1,3}){3}")
AT = r"(?:[(\[{]at[)\]}]|@)"
DOT = r"(?: ?[(\[{]dot[)\]}] ?| ?\.|\. | dot )"
EMAIL_SHAPE = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._+-]*(?: ?{AT} ?[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*{DOT}| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot )[A-Za-z]{{2,6}}", re.I)
AT_DOT = re.compile(rf"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]+(?: ?{AT} ?| at )[A-Za-z0-9-]+", re.I)
#: Each EMAIL_SHAPE holds one of these, in small letters.
SIGNS_OF_AT = ("@", "(at)", "[at]", "{at}", " dot ")
IP_SHAPE = re.compile(r"[0-9]{1,3}(?: ?[\[(]?(?:\.|dot)[\])]? ?[0-9]{1,3}){3}")
NUMBER_SHAPE = re.compile(r"[+(]?[0-9][0-9\s().,\[\]/_+-]*[0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{12,}={0,2}")
MARGIN = 40
CUES = [
    {"email", "mail", "e", "contact", "write", "reach"},
    {"ip", "host", "address", "server", "ping"},
    {"card", "visa", "mastercard", "credit", "amex", "charge"},
    {"phone", "tel", "call", "mobile", "fax", "telephone", "ring", "cell", "telefon"},
    {"token", "key", "secret", "password", "passwd", "apikey", "auth", "bearer", "credential", "pwd"},
]
NOT_CUES = {"isbn", "version", "order", "invoice", "id", "number", "no", "ref", "page", "section", "$", "€", "£", "#", "commit", "sha256", "md5", "iban", "ticket", "serial"}
#: Words before " at " that aren't the name of an account, and after it that aren't the name of a host.
PLAIN = set("meet met look looked be was were is are arrive arrived stay start started end noon home work once least all first last night not that the we they him her us it and or best".split())
GROUPS = re.compile(r"[0-9]+")
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[^0-9]+")
IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")


@dataclass(frozen=True)
class Zone:
    """Tokens (start, end) of a part of a text; free: tokens that no base span covers."""

    text: str
    tokens: list[tuple[int, int]]
    free: list[bool]


def plausible(s: str) -> bool:
    n = len(digits_of(s))
    if n == 0 or not s[0].isdigit() and s[0] not in "+(":
        return bool(EMAIL_SHAPE.fullmatch(s) or n and SECRET.fullmatch(s))
    return 7 <= n <= 19 and bool(NUMBER_SHAPE.fullmatch(s)) or 4 <= n <= 12 and bool(IP_SHAPE.fullmatch(s)) or bool(EMAIL_SHAPE.fullmatch(s) or SECRET.fullmatch(s))


def features(zone: Zone, i: int, j: int) -> list[float]:
    """Of the whole span of tokens i..j (j exclusive)."""
    text, tokens = zone.text, zone.tokens
    start, end = tokens[i][0], tokens[j - 1][1]
    s = text[start:end]
    groups = GROUPS.findall(s)
    d, sizes = "".join(groups), list(map(len, groups))
    left = {text[a:b].lower() for a, b in tokens[max(0, i - 4) : i]}
    before = text[tokens[i - 1][0] : tokens[i - 1][1]] if i else ""
    right = text[tokens[j][0] : tokens[j][1]] if j < len(tokens) else ""
    touching = bool(i) and tokens[i - 1][1] == start and before not in "(,;:=\"'<"
    touching |= j < len(tokens) and tokens[j][0] == end and right not in ").,;:\"'!?>%$&*#|"
    number = LETTER.search(s) is None
    near = [text[a:b] for a, b in tokens[max(0, i - 3) : i]]
    email, ip = bool(EMAIL_SHAPE.fullmatch(s)), bool(IP_SHAPE.fullmatch(s)) and octets(groups)
    secret = bool(SECRET.fullmatch(s)) and not email
    pan = number and 14 <= len(d) <= 19
    marks = {m.strip() for m in OTHER.findall(s)}
    words = re.findall(r"[a-z]+", s.lower()) if email else []
    even = len(sizes) >= 4 and set(sizes[:-1]) == {4} and sizes[-1] <= 4
    rising = number and sizes[-2:] == [3, 4]
    return [
        1.0,
        float(email),
        float(email and touching),
        float(email and bool(PLAIN & set(words[:1] + words[2:3])) and "@" not in s),
        float(email and "@" not in s and "(" not in s and "[" not in s and "{" not in s),
        float(ip),
        float(ip and ("[" in s or "(" in s or "dot" in s)),
        float(pan and luhn(d)),
        float(pan and not luhn(d)),
        float(pan and even),
        float(pan and len(sizes) == 1),
        float(number and 9 <= len(d) <= 13),
        float(number and len(d) < 9),
        float(rising),
        float(number and sizes == [3, 3, 4]),
        float(number and d.startswith("0")),
        float(number and len(sizes) >= 4 and set(sizes) == {2}),
        float(number and len(sizes) == 1),
        float(number and s[0] in "+("),
        float(number and len(marks) == 1),
        float("," in s),
        float("\n" in s),
        float(number and touching),
        float(number and bool(re.search(r"[^0-9]{4,}", s))),
        float(bool(NOT_CUES & left)),
        float(any(len(w) == 4 and IBAN_HEAD.fullmatch(w) for w in near)),
        float(secret),
        float(secret and touching),
        float(secret and len(s) >= 20),
        float(secret and before in ("=", ":", "\"", "'") and before != ""),
        float(secret and right in ("\"", "'") and right != ""),
        float(secret and len(set(s)) >= 10),
        float(secret and len(sizes) >= 3),
        *(float(bool(c & left)) for c in CUES),
        (j - i) / MAX_TOKENS,
    ]


N_FEATURES, NONE = 39, len(KINDS)


def candidates(zone: Zone) -> Iterator[tuple[int, int]]:
    """The segments that may be entities."""
    text, tokens = zone.text, zone.tokens
    for i, (start, stop) in enumerate(tokens):
        if not zone.free[i] or text[start] not in LOCAL + "(":
            continue
        digits, letters = 0, False
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            a, end = tokens[j - 1]
            if not zone.free[j - 1] or end - start > MAX_CHARS:
                break
            if (token := text[a:end]).isdigit():
                digits += end - a
            elif text[a].isalnum():
                letters, digits = True, digits + len(digits_of(token))
            if digits > 19 and not letters:
                break
            if (text[end - 1].isalnum() or text[end - 1] == "=") and plausible(text[start:end]):
                yield i, j


def rows_of(zone: Zone, found: list[tuple[int, int]]) -> np.ndarray:
    return np.array([features(zone, i, j) for i, j in found]).reshape(len(found), N_FEATURES)


@dataclass
class SemiMarkov:
    weights: np.ndarray  # features x kinds
    moves: np.ndarray  # from (kinds, then none) x to

    def lattice(self, zone: Zone, found: list[tuple[int, int]], scores: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """By the token after them: (start, kind, candidate, score) of all segments that end there."""
        ends: list[list[tuple[int, int, int, float]]] = [[] for _ in range(len(zone.tokens) + 1)]
        for j in range(1, len(ends)):
            ends[j].append((j - 1, NONE, -1, 0.0))
        for c, (i, j) in enumerate(found):
            for kind in range(len(KINDS)):
                ends[j].append((i, kind, c, float(scores[c, kind])))
        return ends

    def decode(self, zone: Zone) -> list[Span]:
        found = list(candidates(zone))
        if not found:
            return []
        # In blocks: features of a long zone's candidates needn't be in memory at once.
        scores = np.concatenate([rows_of(zone, found[at : at + 1000]) @ self.weights for at in range(0, len(found), 1000)])
        ends, n = self.lattice(zone, found, scores), len(zone.tokens)
        best = np.full((n + 1, NONE + 1), -np.inf)
        best[0, NONE] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        into = best[0][:, None] + self.moves  # of each place, the scores of moves from it
        reach = [into.max(0)]
        came = [into.argmax(0)]
        for j in range(1, n + 1):
            for i, kind, _, score in ends[j]:
                if (total := reach[i][kind] + score) > best[j, kind]:
                    best[j, kind], back[j, kind] = total, (i, int(came[i][kind]))
            into = best[j][:, None] + self.moves
            reach.append(into.max(0))
            came.append(into.argmax(0))
        out, j, kind = [], n, int(best[n].argmax())
        while j > 0:
            i, before = back[j, kind]
            if kind != NONE:
                out.append((zone.tokens[i][0], kind, zone.tokens[j - 1][1]))
            j, kind = i, before
        return out[::-1]

    def gradient(self, zone: Zone, gold: set[tuple[int, int, int]], found: list, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of the segmentation whose entities are gold (start token, end token, kind)."""
        ends, n = self.lattice(zone, found, rows @ self.weights), len(zone.tokens)
        ahead, behind = np.full((n + 1, NONE + 1), -np.inf), np.full((n + 1, NONE + 1), -np.inf)
        ahead[0, NONE] = 0.0
        for j in range(1, n + 1):
            for i, kind, _, score in ends[j]:
                ahead[j, kind] = np.logaddexp(ahead[j, kind], np.logaddexp.reduce(ahead[i] + self.moves[:, kind]) + score)
        behind[n] = 0.0
        for j in range(n, 0, -1):
            for i, kind, _, score in ends[j]:
                behind[i] = np.logaddexp(behind[i], self.moves[:, kind] + score + behind[j, kind])
        total = np.logaddexp.reduce(ahead[n])
        dw, dm = np.zeros_like(self.weights), np.zeros_like(self.moves)
        for j in range(1, n + 1):
            for i, kind, c, score in ends[j]:
                p = np.exp(ahead[i] + self.moves[:, kind] + score + behind[j, kind] - total)
                dm[:, kind] -= p
                if c >= 0:
                    dw[:, kind] -= p.sum() * rows[c]
        at, before = 0, NONE
        starts = {i: (j, k) for i, j, k in gold}
        place = {x: c for c, x in enumerate(found)}
        while at < n:
            j, kind = starts.get(at, (at + 1, NONE))
            dm[before, kind] += 1
            if kind != NONE:
                dw[:, kind] += rows[place[at, j]]
            at, before = j, kind
        return dw, dm


class Taken:
    """Base spans as intervals apart from each other, for questions in logarithmic time."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def touch(self, a: int, b: int) -> bool:
        return bisect_left(self.starts, b) > bisect_right(self.ends, a)

    def hold(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and b <= self.ends[k]


def zone_of(text: str, start: int, end: int, taken: Taken) -> Zone:
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]
    return Zone(text, tokens, [not taken.touch(a, b) for a, b in tokens])


def training_text(seed: int = 7, n: int = 420) -> list[tuple[str, list[Span]]]:
    """Labelled sentences: entities in forms that the base patterns miss, and numbers, runs and phrases that are none."""
    r = random.Random(seed)
    filler = "the report says that we were there and it was fine so please see her note about this on monday or later".split()
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    octet = lambda: str(r.randint(0, 255))
    end = lambda: r.choice(["com", "org", "net", "de", "fr", "io", "co.uk"])
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: r.choice("abcXYZ") + "".join(r.choice("0123456789abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMN") for _ in range(k)) + number(1)

    def card(good: bool = True) -> list[str]:
        d = r.choice("3456") + number(14)
        d += next(c for c in "0123456789" if luhn(d + c) == good)
        return [d[i : i + 4] for i in range(0, 16, 4)]

    def spoken() -> str:
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), ("at", "dot"), ("(at)", "dot"), ("AT", "DOT"), ("[at]", "."), ("(at)", "."), ("@", " ."), ("@", "dot")])
        local, host, last = r.choice([word(), f"{word()}.{word()}", word() + number(2)]), word(), r.choice(["com", "org", "net", "de"])
        if at.lower() == "at" or r.random() < 0.5:
            return f"{local} {at} {host}{dot if dot in ('.', ' .') else f' {dot} '}{last}"
        return f"{local}{at}{host}{dot if dot != 'dot' else ' dot '}{last}"

    pairs = lambda: f"0{r.randint(1, 9)}{(m := r.choice(' .-'))}" + m.join(number(2) for _ in range(4))
    name = lambda: r.choice(["token", "api_key", "secret", "password", "auth_token", "access key", "client_secret"])
    makers = [
        (0, spoken),
        (0, spoken),
        (0, lambda: f"{word()}.{word()} @ {word()}.{r.choice(['com', 'net', 'de'])}"),
        (1, lambda: r.choice(["[.]", " . ", "(.)", "[dot]", " dot "]).join(octet() for _ in range(4))),
        (2, lambda: r.choice([".", "/", "  ", " - ", "_"]).join(card())),
        (3, lambda: f"({number(3)}) {number(3)}-{number(4)}"),
        (3, lambda: r.choice(["-", ".", " "]).join([number(3), number(3), number(4)])),
        (3, pairs),
        (3, lambda: f"0{number(2)} {number(r.choice([6, 7, 8]))}"),
        (3, lambda: f"0{number(3)}/{number(7)}"),
        (4, lambda: hexes(r.choice([32, 40, 64]))),
        (4, lambda: mixed(r.choice([18, 24, 38]))),
        (4, lambda: f"sk_{mixed(24)}"),
        (NONE, lambda: f"20{number(2)}-0{r.randint(1, 9)}-1{number(1)} 1{number(1)}:2{number(1)}"),
        (NONE, lambda: f"version {number(1)}.{number(2)}.{number(3)}.{number(4)}"),
        (NONE, lambda: f"${number(3)},{number(3)},{number(3)}.{number(2)}"),
        (NONE, lambda: f"isbn 978-{number(1)}-{number(2)}-{number(6)}-{number(1)}"),
        (NONE, lambda: f"{r.choice(['order', 'invoice', 'ticket', 'serial'])} {number(r.choice([8, 10, 12, 16]))}"),
        (NONE, lambda: number(r.choice([7, 9, 10, 12, 16, 18]))),
        (NONE, lambda: "".join(card(False))),
        (NONE, lambda: r.choice(".-/").join(card(False))),
        (NONE, lambda: f"{number(4)} {number(4)} {number(3)}"),
        (NONE, lambda: f"{word()}{number(10)}{word()}"),
        (NONE, lambda: f"{number(3)}, {number(3)}, {number(4)} and {number(4)}"),
        (NONE, lambda: f"{number(2)}/{number(2)}/{number(4)} - {number(2)}/{number(2)}/{number(4)}"),
        (NONE, lambda: f"{r.choice(['DE', 'FR', 'GB'])}{number(2)} {number(4)} {number(4)} {number(4)} {number(4)} {number(2)}"),
        (NONE, lambda: f"{r.choice(sorted(PLAIN))} at {r.choice(sorted(PLAIN))} dot com {r.choice(['bubble', 'boom', 'era'])}"),
        (NONE, lambda: f"{r.choice(sorted(PLAIN))} at {word()} dot com {r.choice(['bubble', 'boom'])}"),
        (NONE, lambda: f"{r.choice(['commit', 'sha256', 'md5', 'id'])} {hexes(r.choice([32, 40, 64]))}"),
        (NONE, lambda: f"{word()}-{word()}-{word()}{number(2)}"),
        (NONE, lambda: f"{word()}/{word()}/{word()}{number(1)}"),
    ]
    out = []
    for _ in range(n):
        text, spans = " ".join(r.choices(filler, k=r.randint(0, 4))), []
        for _ in range(r.randint(1, 2)):
            kind, make = r.choice(makers)
            made, quote, cue = make(), "", ""
            if kind == 4:
                cue, quote = r.choice([f"{name()} = ", f"{name()}: ", f"{name().upper()}="]), r.choice(['"', '"', "'", ""])
            elif kind != NONE and r.random() < 0.4 or made[0] == "0" and kind == 3:
                cue = r.choice(sorted(CUES[kind])) + r.choice([": ", " "])
            text += (" " if text else "") + cue + quote
            if kind != NONE:
                spans.append((len(text), kind, len(text) + len(made)))
            text += made + quote + r.choice(["", ".", ","]) + " " + " ".join(r.choices(filler, k=r.randint(1, 4)))
        out.append((text, spans))
    return out


def learned(epochs: int = 14, rate: float = 0.5, decay: float = 2e-3) -> SemiMarkov:
    """Adagrad on training_text(). Sentences with an entity that is no candidate teach nothing."""
    model = SemiMarkov(np.zeros((N_FEATURES, len(KINDS))), np.zeros((NONE + 1, NONE + 1)))
    model.weights[0] = -1.0
    cases = []
    for text, spans in training_text():
        zone = zone_of(text, 0, len(text), Taken([s for s in base_spans(text) if s not in spans]))
        first, last = {a: k for k, (a, _) in enumerate(zone.tokens)}, {b: k + 1 for k, (_, b) in enumerate(zone.tokens)}
        found = list(candidates(zone))
        rows = rows_of(zone, found)
        gold = {(first[s], last[e], kind) for s, kind, e in spans}
        if all((i, j) in found for i, j, _ in gold):
            cases.append((zone, gold, found, rows))
    seen_w, seen_m = np.full_like(model.weights, 1e-2), np.full_like(model.moves, 1e-2)
    order = random.Random(3)
    for _ in range(epochs):
        order.shuffle(cases)
        for at in range(0, len(cases), 8):
            grads = [model.gradient(*c) for c in cases[at : at + 8]]
            dw, dm = sum(g[0] for g in grads) - decay * model.weights, sum(g[1] for g in grads) - decay * model.moves
            seen_w += dw**2
            seen_m += dm**2
            model.weights += rate * dw / np.sqrt(seen_w)
            model.moves += rate * dm / np.sqrt(seen_m)
    return model


WEIGHTS = "pii_weights.json"


@lru_cache(1)
def trained() -> SemiMarkov:
    """The weights that learned() gave."""
    kept = json.loads(pkgutil.get_data(__package__, WEIGHTS))
    return SemiMarkov(np.array(kept["weights"]), np.array(kept["moves"]))


def zones(text: str, base: list[Span]) -> list[Zone]:
    """The parts of a text that may hold further entities, MARGIN characters wider on both sides; parts that overlap are one."""
    places = []
    if DIGIT.search(text):
        places += [m.span() for m in NUMBERS.finditer(text)] + [m.span() for m in SECRET.finditer(text)]
    small = text.lower()
    if any(w in small for w in SIGNS_OF_AT):
        places += [m.span() for m in AT_DOT.finditer(text)]
    taken = Taken(base)
    out: list[list[int]] = []
    for a, b in sorted(p for p in places if not taken.hold(*p)):
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [zone_of(text, a, b, taken) for a, b in out]


def all_spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    added = [s for zone in zones(text, base) for s in model.decode(zone)]
    return base, sorted({*base, *added})


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def pii_report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans, n_added, n_spans."""
    texts_in_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", trained()) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(N_BASE)]
            digests = pa.array([hashlib.sha256(as_text(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([as_text(every) for _, every in found], pa.string())
            added = pa.array([len(every) - len(base) for base, every in found], pa.int64())
            every = pa.array([len(every) for _, every in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans, added, every], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def masked(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, becomes the name of its first kind in brackets."""
    out, at, until = [], 0, -1
    for s, k, e in spans:
        if s >= until:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = until = e
        else:
            at = until = max(until, e)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, with personal data in `text` masked. Null text stays null, other columns stay as they are."""
    texts_in_batches(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else masked(t, all_spans(t, trained())[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


if __name__ == "__main__":
    model = learned()
    rounded = {"weights": np.round(model.weights, 4).tolist(), "moves": np.round(model.moves, 4).tolist()}
    Path(__file__).with_name(WEIGHTS).write_text(json.dumps(rounded) + "\n")
