"""Detectors: exact spans, values that must go, values that must stay."""

import pytest

from maskwright.fixtures import EXACT
from maskwright.operators.spans import find
from maskwright.plans.masking import PipelineConfig, mask
from maskwright.rules import BY_NAME, CORPORATE, DATES, DEFAULT


def test_registries():
    assert len(DEFAULT) == 29 and len(CORPORATE) == 27 and len(DATES) == 2


@pytest.mark.parametrize(("name", "text", "expected"), EXACT, ids=[f"{x[0]}-{k}" for k, x in enumerate(EXACT)])
def test_exact(name, text, expected):
    found = find(BY_NAME[name], text)
    for s, value in zip(found, expected, strict=True):
        assert text[s.start : s.end] == s.text
        assert s.text.lstrip("№ ") == value or s.text == value


def test_driver_licence_by_context():
    assert find(BY_NAME["SERIES_NUMBER"], "Водительское удостоверение 66 14 887766")[0].label == "DRIVER_LICENSE"


MUST_STAY = ["Приложение № 1; п. № 5", "п. 3.1 договора", "и т.д. 5 лет", "Обычное предложение без данных.", "встреча в 12:30", "[PERSON_1] уже скрыт"]


@pytest.mark.parametrize("text", MUST_STAY)
def test_unchanged(text):
    r = mask(text, PipelineConfig())
    assert r.masked == text and not r.mapping


MUST_GO = [
    ("Почта a@b.ru важна. Пишите снова на a@b.ru.", "a@b.ru", 1),
    ("Карты 6271 8855 1122 3344 и 1234 5678 9012 3456 разные.", "6271", 2),
    ("В выписке написали ИНН 7711222333.", "7711222333", 1),
    ("Иванов Никита Петрович пришёл. Никита, добрый день!", "Никита", 2),
    ("ООО «Ромашка» (далее — Ромашка).", "Ромашка", 2),
    ("Минфином решено", "Минфин", 1),
]


@pytest.mark.parametrize(("text", "value", "entities"), MUST_GO)
def test_masked(text, value, entities):
    r = mask(text, PipelineConfig())
    assert value not in r.masked and len(r.mapping) == entities
    for s in r.spans:
        assert text[s.start : s.end] == s.text


def test_skips_change_nothing():
    """Rules that are skipped for texts without Cyrillic letters or digits find nothing there."""
    texts = ["The quick a@b.com, see http://x.ru and +1 212 555 0187, $100, № AB-12, VIN XTA210990Y2765432", "no digits: a@b.com @handle report.docx № ABC-D", *[t for _, t, _ in EXACT]]
    from maskwright.operators.spans import detect

    for text in texts:
        every = [s for rule in (*DEFAULT, *CORPORATE, *DATES) for s in find(rule, text)]
        assert detect(text, (*DEFAULT, *CORPORATE, *DATES)) == every
