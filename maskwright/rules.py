"""Detection rules as data, and the registries that group them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from . import patterns as P


#: Rules that match texts without Cyrillic letters, too.
ANY_SCRIPT = frozenset(
    "EMAIL URL ACCOUNT IP_ADDRESS CREDIT_CARD SNILS_FMT PHONE CONTRACT CONTRACT_NUM CONTRACT_QUOTED FILE AMOUNT BANK_ACCOUNT_FMT VIN CADASTRE DATE".split()
)


@dataclass(frozen=True)
class Rule:
    """One detector: `groups` names the groups that are reported (0: the whole match); `span`: one span from the first
    group's start to the last one's end. `anchor` says where group 1 lies in the match, for engines that give only its text: W
    (whole match), T (at its end), H (at its start), P (one character before its end)."""

    name: str
    label: str
    pattern: str
    groups: tuple[int, ...] = (0,)
    span: bool = False
    ignorecase: bool = True
    anchor: str = "W"
    strip: str | None = P.TRIM
    source: str = "regex"

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.IGNORECASE if self.ignorecase else 0)

    @property
    def cyrillic(self) -> bool:
        """Whether a match must hold a Cyrillic letter; texts without one then skip the rule."""
        return self.name not in ANY_SCRIPT

    @property
    def java(self) -> str:
        return ("(?iuU)" if self.ignorecase else "(?U)") + self.pattern


def _tail(name: str, label: str, pattern: str, **more) -> Rule:
    return Rule(name, label, pattern, (1,), anchor="T", **more)


def _requisite(word: str, label: str) -> Rule:
    return _tail(label, label, P.NOT_AFTER_LETTER + word + P.NOT_BEFORE_LETTER + P.REQUISITE)


DEFAULT = (
    _tail("STAFF_ID", "STAFF_ID", P.STAFF_ID),
    Rule("EMAIL", "EMAIL", P.EMAIL),
    Rule("URL", "URL", P.URL),
    Rule("ACCOUNT", "ACCOUNT", P.ACCOUNT),
    Rule("CITY", "LOCATION", P.CITY),
    Rule("IP_ADDRESS", "IP_ADDRESS", P.IP_ADDRESS),
    Rule("CREDIT_CARD", "CREDIT_CARD", P.CREDIT_CARD),
    _tail("INN", "INN", P.INN),
    _tail("SNILS_KW", "SNILS", P.SNILS_KEYWORD),
    Rule("SNILS_FMT", "SNILS", P.SNILS_FORMAT),
    _tail("OMS_KW", "OMS", P.OMS),
    _tail("ZAGRANPASSPORT", "PASSPORT", P.FOREIGN_PASSPORT),
    Rule("SERIES_NUMBER", "PASSPORT", P.SERIES_NUMBER, (1, 2), span=True),
    Rule("BIRTH_CERTIFICATE", "BIRTH_CERTIFICATE", P.BIRTH_CERTIFICATE),
    _tail("BIRTH_CERTIFICATE_KW", "BIRTH_CERTIFICATE", P.BIRTH_CERTIFICATE_KEYWORD),
    Rule("BIRTH_CERTIFICATE_SPLIT", "BIRTH_CERTIFICATE", P.BIRTH_CERTIFICATE_SPLIT, (1, 2), ignorecase=False, strip=None),
    Rule("MILITARY_FMT", "MILITARY_ID", P.MILITARY_FORMAT),
    _tail("MILITARY_KW", "MILITARY_ID", P.MILITARY_KEYWORD),
    Rule("MILITARY_SERIES", "MILITARY_ID", P.MILITARY_SERIES, (1, 2), ignorecase=False, strip=None),
    Rule("PERSON_INITIALS", "PERSON", P.PERSON_INITIALS, ignorecase=False),
    Rule("PERSON_PATRONYMIC", "PERSON", P.PERSON_PATRONYMIC, ignorecase=False),
    _tail("POSTAL", "POSTAL_CODE", P.POSTAL),
    Rule("POSTAL_ADDR", "POSTAL_CODE", P.POSTAL_ADDRESS, (1,), anchor="H"),
    Rule("HOUSE", "HOUSE", P.HOUSE),
    Rule("HOUSE_STANDALONE", "HOUSE", P.HOUSE_ALONE),
    _tail("MED_ICD", "MEDICAL", P.DISEASE_CODE),
    _tail("MED_RECORD", "MEDICAL", P.MEDICAL_RECORD),
    Rule("PHONE", "PHONE", P.PHONE),
    _tail("PHONE_EXT", "PHONE", P.PHONE_EXTENSION),
)
REQUISITES = (
    _requisite("КПП", "KPP"),
    _requisite("ОГРН(?:ИП)?", "OGRN"),
    _requisite("БИК", "BIK"),
    _requisite("ОКПО", "OKPO"),
    _tail("OKVED", "OKVED", P.OKVED),
    _requisite("ОКТМО", "OKTMO"),
    _requisite("ОКАТО", "OKATO"),
    _tail("BANK_ACCOUNT_KW", "BANK_ACCOUNT", P.BANK_ACCOUNT_KEYWORD),
    Rule("BANK_ACCOUNT_FMT", "BANK_ACCOUNT", P.BANK_ACCOUNT_FORMAT),
    Rule("BANK", "ORG", P.BANK),
    _tail("BANK_KW", "ORG", P.BANK_KEYWORD),
    Rule("VIN", "VIN", P.VIN),
    Rule("PLATE", "PLATE", P.PLATE),
    Rule("CADASTRE", "CADASTRE", P.CADASTRE),
)
ADMIN_CODES = (
    _tail("ADMIN_CODE_STRUCT_KW", "ADMIN_CODE", P.ADMIN_STRUCTURE),
    _tail("ADMIN_CODE_KOSGU", "ADMIN_CODE", P.ADMIN_KOSGU),
    _tail("ADMIN_CODE_SUBCONTO", "ADMIN_CODE", P.ADMIN_SUBCONTO),
    _tail("ADMIN_CODE_SHIFR", "ADMIN_CODE", P.ADMIN_CIPHER),
    _tail("ADMIN_CODE_REG_NUMBER", "ADMIN_CODE", P.ADMIN_REGISTRATION),
    Rule("ADMIN_CODE_STAMP", "ADMIN_CODE", P.ADMIN_STAMP, (1,), anchor="P"),
)
CORPORATE = (
    Rule("CONTRACT", "CONTRACT", P.CONTRACT),
    Rule("CONTRACT_NUM", "CONTRACT", P.CONTRACT_NUMBER),
    Rule("CONTRACT_QUOTED", "CONTRACT", P.CONTRACT_QUOTED),
    Rule("ORG_LEGAL", "ORG", P.ORG_LEGAL),
    Rule("FILE", "FILE", P.FILE),
    Rule("AMOUNT", "AMOUNT", P.AMOUNT),
    _tail("PRICE_KW", "AMOUNT", P.PRICE_KEYWORD, source="price_kw"),
    *REQUISITES,
    *ADMIN_CODES,
)
#: Off unless asked for: dates aren't personal data, and masking them hides a document's deadlines.
DATES = (Rule("DATE", "DATE", P.DATE, strip=P.TRIM_DATE), _tail("DATE_RANGE", "DATE", P.DATE_RANGE))
BY_NAME = {r.name: r for r in (*DEFAULT, *CORPORATE, *DATES)}
