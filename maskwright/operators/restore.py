"""Restoring one text, and mappings as JSON files. (For corpora: functions/extract.)"""

from __future__ import annotations

import json
import re
from pathlib import Path

from .. import patterns as P

TOKEN = re.compile(P.PLACEHOLDER)


def unknown(text: str, mapping: dict[str, str]) -> list[str]:
    """Placeholders of the text that the mapping lacks, in order."""
    return [m[0] for m in TOKEN.finditer(text) if m[0] not in mapping]


def restore(text: str, mapping: dict[str, str], strict: bool = False) -> str:
    """One pass; unknown placeholders stay. strict: KeyError if the restored text holds any."""
    keys = sorted(filter(None, mapping), key=len, reverse=True)
    out = re.sub("|".join(map(re.escape, keys)), lambda m: mapping[m[0]], text) if keys else text
    if strict and (left := unknown(out, mapping)):
        raise KeyError(f"unresolved placeholders: {sorted(set(left))}")
    return out


def save_mapping(mapping: dict[str, str], path: str | Path) -> None:
    Path(path).write_text(json.dumps(mapping, ensure_ascii=False, indent=1), encoding="utf-8")


def load_mapping(path: str | Path) -> dict[str, str]:
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in data.items()):
        raise ValueError("a mapping is a JSON object of strings")
    return data
