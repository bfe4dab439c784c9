"""Texts that the driver's tables lack (they hold no Cyrillic letters), with what must be found in them, written by hand."""

from __future__ import annotations

#: Rule, text, and the values that the rule finds in it, in order ("№" and blanks before a value left out).
EXACT = [
    ("EMAIL", "Пишите: n . makarov@aol . com сегодня", ["n . makarov@aol . com"]),
    ("EMAIL", "почта иван@почта.рф.\nСогласовано", ["иван@почта.рф"]),
    ("URL", "см. https://site.ru/a?b=1, и lamoda.ru/login тут", ["https://site.ru/a?b=1", "lamoda.ru/login"]),
    ("ACCOUNT", "пишите @ivan_petrov или a@b.ru", ["@ivan_petrov"]),
    ("CITY", "г. Иркутск и 20.01.2026г. по городу, с Иваном", ["г. Иркутск"]),
    ("IP_ADDRESS", "адрес 192.168.1.45. и 10:20:30", ["192.168.1.45"]),
    ("CREDIT_CARD", "4276 3800 1234 5678, 4276380012345678, 40702810900000012345", ["4276 3800 1234 5678", "4276380012345678"]),
    ("INN", "ИНН 7711222333; длинный текст (5 слов)", ["7711222333"]),
    ("SNILS_KW", "СНИЛС: 112-233-445 95", ["112-233-445 95"]),
    ("SNILS_FMT", "номер 112-233-445  95", ["112-233-445  95"]),
    ("OMS_KW", "полис единого образца 5678 1234 9012 3456, промсвязь 5", ["5678 1234 9012 3456"]),
    ("ZAGRANPASSPORT", "загранпаспорт 71 1234567", ["71 1234567"]),
    ("SERIES_NUMBER", "паспорт 2518 445566 выдан", ["2518 445566"]),
    ("BIRTH_CERTIFICATE", "II - АВ 123456", ["II - АВ 123456"]),
    ("BIRTH_CERTIFICATE_KW", "свидетельство о рождении II-АВ 123456", ["II-АВ 123456"]),
    ("BIRTH_CERTIFICATE_SPLIT", "серия III - АГ, номер 112233", ["III - АГ", "112233"]),
    ("MILITARY_FMT", "АА 1234567 и до 500 000", ["АА 1234567"]),
    ("MILITARY_KW", "военный билет серия МЗ, номер 0045678", ["МЗ, номер 0045678"]),
    ("MILITARY_SERIES", "серия «АА» номер 1234567", ["АА", "1234567"]),
    ("PERSON_INITIALS", "Носов Д.В. и т.д. Слово, Д. В. Носов", ["Носов Д.В", "Д. В. Носов"]),
    ("PERSON_PATRONYMIC", "Самозанятый Дронова Екатерина Сергеевна\nДата", ["Дронова Екатерина Сергеевна"]),
    ("POSTAL", "почтовый индекс 664003", ["664003"]),
    ("POSTAL_ADDR", "101000, г. Москва", ["101000"]),
    ("HOUSE", "ул. Мира, д. 15, офис 301 и т.д. 5 лет", ["д. 15, офис 301"]),
    ("HOUSE_STANDALONE", "офис 301, IV кв. 2025 г., кв. м", ["офис 301"]),
    ("MED_ICD", "диагноз J06.9", ["J06.9"]),
    ("MED_RECORD", "история болезни № 12-345", ["12-345"]),
    ("STAFF_ID", "табельный номер 00451", ["00451"]),
    ("PHONE", "+7 (914) 123-45-67, 861-296-11-12, (3952) 405-000", ["+7 (914) 123-45-67", "861-296-11-12", "(3952) 405-000"]),
    ("PHONE_EXT", "доб. 1234", ["1234"]),
    ("CONTRACT", "№ ЧЕБ-2026-01, № 1, № номер", ["ЧЕБ-2026-01"]),
    ("CONTRACT_NUM", "№ 77/2026 и № 42 от 01.07.2026, № 5", ["77/2026", "42"]),
    ("CONTRACT_QUOTED", "№21«А»-О", ["21«А»-О"]),
    ("ORG_LEGAL", "ООО «Ромашка», ООО без", ["ООО «Ромашка»"]),
    ("FILE", "файл Отчёт_2026.xlsx тут", ["Отчёт_2026.xlsx"]),
    ("AMOUNT", "49 500 (сорок девять тысяч) рублей 00 копеек; $1000; 97%", ["49 500 (сорок девять тысяч) рублей 00 копеек", "$1000"]),
    ("PRICE_KW", "Цена: 1 200 000; сумму, указанную в п. 3.1", ["1 200 000"]),
    ("KPP", "КПП 771101001", ["771101001"]),
    ("OGRN", "ОГРНИП 304770000012345", ["304770000012345"]),
    ("BIK", "БИК 044525225, БИК 12", ["044525225"]),
    ("OKPO", "ОКПО: 12345678", ["12345678"]),
    ("OKTMO", "код ОКТМО 45379000", ["45379000"]),
    ("OKATO", "ОКАТО 45286560000", ["45286560000"]),
    ("OKVED", "ОКВЭД 62.01", ["62.01"]),
    ("BANK_ACCOUNT_KW", "р/с 4070 2810 9000 0001 2345", ["4070 2810 9000 0001 2345"]),
    ("BANK_ACCOUNT_FMT", "40702810900000012345", ["40702810900000012345"]),
    ("BANK", "Филиал № 7 Банка ВТБ (ПАО)", ["Филиал № 7 Банка ВТБ (ПАО)"]),
    ("BANK_KW", "Банк: Какой-то Банк, БИК", ["Какой-то Банк"]),
    ("VIN", "VIN XTA210990Y2765432", ["XTA210990Y2765432"]),
    ("PLATE", "номер А 000 АА 00 и А123ВС77", ["А 000 АА 00", "А123ВС77"]),
    ("CADASTRE", "77:01:0001001:1234", ["77:01:0001001:1234"]),
    ("ADMIN_CODE_STRUCT_KW", "код структуры 012-3", ["012-3"]),
    ("ADMIN_CODE_KOSGU", "КОСГУ 226", ["226"]),
    ("ADMIN_CODE_SUBCONTO", "субконто 45-2", ["45-2"]),
    ("ADMIN_CODE_SHIFR", "шифр 7-14", ["7-14"]),
    ("ADMIN_CODE_REG_NUMBER", "рег. номер 0123-45", ["0123-45"]),
    ("ADMIN_CODE_STAMP", "Штамп отдела (И-118):", ["И-118"]),
    ("DATE", "«12» сентября 2025 года и 12.03.2015г.", ["«12» сентября 2025 года", "12.03.2015г."]),
    ("DATE_RANGE", "с 01.09 по 30.09", ["01.09", "30.09"]),
]

#: Text and what the whole plan makes of it; the last ones hold nothing that must go.
MASKED = [
    ("Почта a@b.ru важна. Пишите снова на a@b.ru.", "Почта [EMAIL_1] важна. Пишите снова на [EMAIL_1]."),
    ("Карты 6271 8855 1122 3344 и 1234 5678 9012 3456 разные.", "Карты [CREDIT_CARD_1] и [CREDIT_CARD_2] разные."),
    ("В выписке написали ИНН 7711222333.", "В выписке написали ИНН [INN_1]."),
    ("Приложение № 1; п. № 5", "Приложение № 1; п. № 5"),
    ("п. 3.1 договора", "п. 3.1 договора"),
    ("и т.д. 5 лет", "и т.д. 5 лет"),
    ("Обычное предложение без данных.", "Обычное предложение без данных."),
    ("встреча в 12:30", "встреча в 12:30"),
    ("[PERSON_1] уже скрыт", "[PERSON_1] уже скрыт"),
]
