"""Parts of a text with their offsets."""

from __future__ import annotations


def _lines(text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line) + 1
    return out


def chunks(text: str, max_chars: int, group: bool = True) -> list[tuple[int, str]]:
    """(offset, part). group: whole lines together, up to max_chars (a longer line alone). Otherwise one line each, a longer one cut at
    the last space that fits. Blank parts are left out; text[offset:offset + len(part)] is the part."""
    out: list[tuple[int, str]] = []
    if group:
        start, size = 0, 0
        for at, line in _lines(text):
            if at > start and size + len(line) > max_chars:
                out.append((start, text[start : at - 1]))
                start, size = at, 0
            size += len(line) + 1
        out.append((start, text[start:]))
    else:
        for at, line in _lines(text):
            while len(line) > max_chars:
                cut = line.rfind(" ", 0, max_chars)
                cut = cut if cut > 0 else max_chars
                out.append((at, line[:cut]))
                at, line = at + cut, line[cut:]
            out.append((at, line))
    return [(at, part) for at, part in out if part.strip()]
