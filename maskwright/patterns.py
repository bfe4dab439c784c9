"""The patterns, word lists and tables that results depend on. Nothing here is logic.

Patterns are written once for both engines that use them: Python's `re` and Java's regular expressions (Spark adds the
flags (?iuU) or (?U)). They hold no free-spacing white space.
"""

from __future__ import annotations

# Pieces that several patterns share.
DIGIT_SEPARATOR = r"[ \t.\-:;=|/\\_]"
BLOB = r"\d(?:" + DIGIT_SEPARATOR + r"*\d)*"
GAP = r"\D{0,25}?"
NOT_AFTER_LETTER = r"(?<![А-Яа-яЁёA-Za-z])"
NOT_BEFORE_LETTER = r"(?![А-Яа-яЁёA-Za-z])"
TLD = r"ru|рф|com|org|net|io|info|biz|edu|gov|me|app|dev|co|tv|pro|online|site|shop|store|ua|by|kz|de|uk|us|fr|cn"
MONTH = r"(?:январ|феврал|март|апрел|ма[йя]|июн|июл|август|сентябр|октябр|ноябр|декабр)[а-я]*"
YEAR_TAIL = r"(?:\s*(?:года|году|г\.?(?![а-яё])))?"
AMOUNT_NUMBER = r"\d[\d., \u00a0]*"
SCALE = r"(?:тысяч[а-я]*|тыс\.?|миллиард[а-я]*|млрд\.?|миллион[а-я]*|млн\.?)"
CURRENCY = r"(?:рубл[а-я]*|руб\.?|₽|долл[а-я]*|\$|евро)"
SPELLED = r"(?:\([^)\n]{3,90}\)\s*)?"
PATRONYMIC = r"[А-ЯЁ][а-яё]+(?:вич(?:[ауеё]|ем)?|вн[аеоуы]й?)"
NAME_STATUS = r"(?:Самозанят\w+|Граждан\w+|Индивидуальн\w+|Учредител\w+|Директор\w*)"
BANK_NAMES = (
    r"(?:ВТБ|Сбербанк\w*|Сбербанка|Сбер|Альфа[-\s]?[Бб]анк\w*|Тинькофф|Т[-\s]?Банк|"
    r"Газпромбанк\w*|ГПБ|«?Открытие»?|Райффайзен\w*|Совкомбанк\w*|Росбанк\w*|"
    r"Промсвязьбанк\w*|ПСБ|Россельхозбанк\w*|Уралсиб\w*|МКБ|Юникредит\w*|"
    r"Ак\s?Барс|Хоум\s?Кредит|Ситибанк\w*|Банк\s?Дом\.?РФ|Почта\s?Банк\w*)"
)
BRANCH = r"(?:филиал\w*|отделени\w*|доп\.?\s*офис\w*)\s*№?\s*\d+"
CITY_KEYWORD = r"(?:г|гор|пгт|дер|пос|с)\.|(?:город|деревн\w+|село|посёлок|посел\w+|станиц\w+)"
HOUSE_NUMBER = r"\d{1,4}[А-Яа-яЁё]?(?:\s?/\s?\d{1,4}[А-Яа-яЁё]?)?"

# What each detector matches.
EMAIL = (
    r"[A-Za-zА-Яа-яЁё0-9_%+\-]+(?:[ \t]?\.[ \t]?[A-Za-zА-Яа-яЁё0-9_%+\-]+)*"
    r"[ \t]?@[ \t]?[A-Za-zА-Яа-яЁё0-9\-]+(?:[ \t]?\.[ \t]?[A-Za-zА-Яа-яЁё0-9\-]+)*"
    r"[ \t]?\.[ \t]?[A-Za-zА-Яа-яЁё]{2,}"
)
URL = (
    r"https?://[^\s,;()<>«»\"']+"
    r"|www\s?\.\s?[A-Za-z0-9\-]+(?:\s?\.\s?[A-Za-z0-9\-]+)+"
    r"|(?<![@\w])[A-Za-z0-9\-]+(?:\s?\.\s?[A-Za-z0-9\-]+)*\s?\.\s?(?:" + TLD + r")"
    r"(?:\s?/[^\s,;«»()<>\"']*)?(?![A-Za-z0-9])"
)
ACCOUNT = r"(?<![A-Za-z0-9@._/])@[A-Za-z][A-Za-z0-9_]{3,31}"
CITY = NOT_AFTER_LETTER + r"(?:" + CITY_KEYWORD + r")[ \t]*(?-i:[А-ЯЁ])[А-Яа-яё\-]+"
IP_ADDRESS = r"(?<![\w.:])(?:(?:\d{1,3}\.){3}\d{1,3}|(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4})(?![\w:])(?!\.\d)"
CREDIT_CARD = r"(?<!\d)\d{4}(?:[ \t\-]+\d{4}){3}(?!\d)|(?<!\d)\d{16}(?!\d)"
PHONE = (
    r"(?<![\w+])(?:\+\d{1,3}[ \t\-]*\(?\d{1,4}\)?(?:[ \t\-]*\d{2,4}){2,5}"
    r"|[78][ \t\-]*\(?\d{3,4}\)?(?:[ \t\-]*\d{2,4}){2,4}"
    r"|\(?\d{3}\)?-\d{2,3}-\d{2}-\d{2}"
    r"|\(\d{3,5}\)[ \t]*\d{2,3}(?:[ \t\-]\d{2,3}){1,2})(?![\w])"
)
INN = NOT_AFTER_LETTER + r"(?:ИНН(?![А-Яа-яЁёA-Za-z])|налогоплательщик\w*)" + GAP + r"(" + BLOB + r")"
SNILS_KEYWORD = r"СНИЛС\w*" + GAP + r"(" + BLOB + r")"
SNILS_FORMAT = r"(?<!\d)\d{3}[.\- ]{1,3}\d{3}[.\- ]{1,3}\d{3}[.\- ]{0,3}\d{2}(?!\d)"
OMS = NOT_AFTER_LETTER + r"(?:поо?лис\w*|ОМС)" + NOT_BEFORE_LETTER + GAP + r"(" + BLOB + r")"
FOREIGN_PASSPORT = r"(?:загранпаспорт\w*|заграничн\w*\s+паспорт\w*)" + GAP + r"(\d{2}[ \t]?\d{7}|\d{9})(?!\d)"
SERIES_NUMBER = (
    r"(?:сери[ияю]|паспорт\w*|водительск\w*\s+удостоверени\w*)\s*[№:\-]*\s*(\d{2}[ \t]?\d{2})"
    r"(?:(?:\D{0,18}?(?:номер|№)\s*[№:\-]*\s*|[ \t]+)(\d{3}[ \t]?[-]?[ \t]?\d{3}|\d{6}))?"
)
DRIVER_CONTEXT = r"водительс|удостоверени|\bВУ\b|\bправ"
BIRTH_CERTIFICATE = r"[IVXLC]{1,4}[ \t\-+]*[А-ЯЁ]{2}[ \t\-+]*\d{6}"
BIRTH_CERTIFICATE_KEYWORD = r"свидетельств\w*\s+о\s+рождени\w*" + GAP + r"([IVXLC]{1,4}" + DIGIT_SEPARATOR + r"*[А-ЯЁ]{1,2}" + DIGIT_SEPARATOR + r"*\d{6})"
BIRTH_CERTIFICATE_SPLIT = r"(?<![0-9A-Za-zА-Яа-яЁё])([IVX]{1,4}\s?[\-+/]?\s?[А-ЯЁ]{2})(?:.{0,25}?(?:[Нн]омер|№)\s*[—:\-]*\s*(\d{6}))?"
MILITARY_FORMAT = r"(?<![А-ЯЁA-Z])(?<![IVXLC] )(?-i:[А-ЯЁ]{2})[ \t\-_()]*\d(?:[\d \t\-_()]{4,6}\d)(?!\d)"
MILITARY_KEYWORD = r"воен\w*\s+билет\w*" + GAP + r"((?-i:[А-ЯЁ]{2})\D{0,12}?\d{6,7})"
MILITARY_SERIES = r"сери[ияю]\s*[№:\-]*\s*[«»\"]?\s*([А-ЯЁ]{2})\s*[«»\"]?(?:.{0,20}?(?:номер|№)\s*[№:\-]*\s*[«»\"]?\s*(\d{6,7})\b)?"
PERSON_INITIALS = r"[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.(?!\w)|(?<!\w)[А-ЯЁ]\.\s*[А-ЯЁ]\.\s+[А-ЯЁ][а-яё]+"
PERSON_PATRONYMIC = r"(?:(?!" + NAME_STATUS + r"\b)[А-ЯЁ][а-яё]+\s+){1,2}" + PATRONYMIC + r"(?:[ \t]+[А-ЯЁ][а-яё]+)?(?![а-яё])"
POSTAL = r"(?:почтов\w*\s+индекс|индекс)" + GAP + r"(\d{6})(?!\d)"
POSTAL_ADDRESS = r"(?<![\d.])(\d{6})\s*,\s*(?=г\.|гор\.|город|пгт|с\.|д\.|ул\.|пер\.|просп|пр-т|[А-ЯЁ][а-яё]+\s+(?:обл|край|респ|АО|р-н))"
HOUSE = (
    r"(?<!т\.)(?<!т\.[ ])" + NOT_AFTER_LETTER + r"(?:д\.|д(?![А-Яа-яЁё])|дом\w*|влад(?:ение)?\.?)[ \t]*(" + HOUSE_NUMBER + r")"
    r"(?:,?[ \t]*(?:корп(?:ус)?\.?|к\.|стр(?:оение)?\.?)[ \t]*\d{1,4}[А-Яа-яЁё]?)?"
    r"(?:,?[ \t]*(?:кв(?:артира)?\.?|оф(?:ис)?\.?|пом(?:ещение)?\.?)[ \t]*\d{1,4}[А-Яа-яЁё]?)?"
)
HOUSE_ALONE = (
    NOT_AFTER_LETTER + r"(?:кв(?:артира)?\.?|оф(?:ис)?\.?|пом(?:ещение)?\.?)[ \t]*(?!(?:19|20)\d{2}(?!\d))\d{1,4}[А-Яа-яЁё]?(?![ \t]*(?:г\.|году|года))"
)
DISEASE_CODE = r"(?:МКБ[-\s]?10|МКБ|диагноз\w*|код\s+диагноз\w*)" + GAP + r"((?-i:[A-ZА-ЯЁ])\d{2}(?:\.\d{1,2})?)"
MEDICAL_RECORD = r"(?:истори\w*\s+болезн\w*|амбулаторн\w*\s+карт\w*|медицинск\w*\s+карт\w*|карт\w*\s+пациент\w*)" + GAP + r"(" + BLOB + r")"
PHONE_EXTENSION = r"(?:доб\.?|вн\.?|внутр\w*)\s*[№:]?\s*(\d{2,5})(?!\d)"
STAFF_ID = r"(?:табельн\w*\s+номер\w*|личн\w*\s+номер\w*|таб\.?\s*№)" + GAP + r"(" + BLOB + r")"
CONTRACT = (
    r"№\s*(?!(?:номер|дата|договор\w*|приказ\w*|протокол\w*)(?![A-Za-zА-Яа-яЁё0-9\-/_]))"
    r"(?=[^\s]*[A-Za-zА-Яа-яЁё\-])[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9\-/_]{2,}"
)
CONTRACT_NUMBER = r"№\s*\d{1,6}[/\-]\d{1,6}(?:[/\-]\d{1,6})?(?![\d/\-])|№\s*\d{1,6}(?=\s*от\s+[«\"]?\d)"
CONTRACT_QUOTED = r"№\s*\d{1,6}\s*[«\"][А-ЯЁA-Za-z]{1,3}[»\"](?:\s*[-/]\s*[А-ЯЁA-Za-z0-9]+)?"
ORG_LEGAL = r"(?:ООО|ОАО|ЗАО|ПАО|АО|ГК|НКО|АНО|ИП)\s*[«\"][^»\"\n]{1,60}[»\"]"
FILE = (
    r"[«\"]?[A-Za-zА-Яа-яЁё0-9_\-]+\.(?:xlsx?|docx?|pdf|csv|txt|pptx?|zip|rar|jpg|jpeg|png"
    r"|mp[34]|wav|m4a|aac|ogg|avi|mkv|mov|webm)[»\"]?"
)
AMOUNT = (
    AMOUNT_NUMBER + SCALE + r"\s*" + CURRENCY + r"?|" + AMOUNT_NUMBER + SPELLED + CURRENCY + r"(?:[,\s]*\d{2}\s*копе[а-я]*)?"
    r"|[$€₽]\s?" + AMOUNT_NUMBER + r"|\d[\d.,]*\s*%\s*годовых|\d+,\d+\s*%"
)
PRICE_KEYWORD = (
    NOT_AFTER_LETTER + r"(?:цен[аеуой]|стоимост[ьи]|сумм[ауеы]|итого|аванс\w*|оклад\w*|тариф\w*|"
    r"платеж\w*|платёж\w*|НМЦК|номинал\w*|задолженност[ьи]|долг|остаток)"
    r"\D{0,20}?(\d{1,3}(?:[ \u00a0]\d{3})+(?:[.,]\d{1,2})?|\d+[.,]\d{2}|\d{4,})"
)
REQUISITE = GAP + r"(\d{5,})(?!\d)"  # after a keyword
OKVED = NOT_AFTER_LETTER + r"ОКВЭД\w*" + NOT_BEFORE_LETTER + GAP + r"(\d{2}(?:\.\d{1,2}){0,2})"
BANK_ACCOUNT_KEYWORD = (
    r"(?:расч[её]тн\w*|корреспондентск\w*|лицев\w*)?\s*(?:сч[её]т\w*|р\s*[/\\.]\s*с|к\s*[/\\.]\s*с)\s*[№:\-]*\s*((?:\d[ \t]?){20})(?!\d)"
)
BANK_ACCOUNT_FORMAT = r"(?<!\d)\d{20}(?!\d)"
BANK = r"(?:" + BRANCH + r"\s+)?(?:банк[а-я]*\s+)?" + BANK_NAMES + r"(?:\s*\((?:ПАО|АО|ООО|НКО)\))?|" + BRANCH
BANK_KEYWORD = (
    r"(?:наименовани\w*\s+банка|банк\w*\s+(?:получател|плательщик|бенефициар|контрагент\w*|клиент\w*)\w*"
    r"|(?<![А-Яа-яЁё])[Бб]анк)\s*:\s*([^\n,;]{2,70})"
)
VIN = r"(?<![A-Z0-9])(?-i:[A-HJ-NPR-Z0-9]{17})(?![A-Z0-9])"
PLATE = r"(?<![А-Яа-яЁёA-Za-z0-9])(?-i:[АВЕКМНОРСТУХ][ \t]?\d{3}[ \t]?[АВЕКМНОРСТУХ]{2})[ \t]?\d{2,3}(?![А-Яа-яЁё0-9])"
CADASTRE = r"(?<![\d:])\d{2}:\d{2}:\d{6,7}:\d{1,6}(?![\d:])"
ADMIN_STRUCTURE = r"код\s+(?:структур\w*|учреждени\w*|подразделени\w*|бюджетополучател\w*)" + GAP + r"(" + BLOB + r")"
ADMIN_KOSGU = NOT_AFTER_LETTER + r"КОСГУ" + NOT_BEFORE_LETTER + GAP + r"(" + BLOB + r")"
ADMIN_SUBCONTO = r"субконт\w*" + GAP + r"(" + BLOB + r")"
ADMIN_CIPHER = NOT_AFTER_LETTER + r"шифр\w*" + NOT_BEFORE_LETTER + GAP + r"(" + BLOB + r")"
ADMIN_REGISTRATION = r"рег(?:истрационн\w*)?\.?\s*номер\w*" + GAP + r"(" + BLOB + r")"
ADMIN_STAMP = r"штамп\w*[^()\n]{0,80}\(([A-ZА-ЯЁ0-9][A-ZА-ЯЁ0-9\-./]{0,14})\)"
DATE = (
    r"(?<!\d)[«\"]?\d{1,2}[»\"]?\s+" + MONTH + r"(?:\s+\d{4})?" + YEAR_TAIL + r"|" + MONTH + r"\s+\d{4}" + YEAR_TAIL
    + r"|\b\d{1,2}\.\d{1,2}\.\d{2,4}" + YEAR_TAIL + r"(?![0-9])|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b"
    + r"|(?<![\d.])(?:0[1-9]|1[0-2])\.\d{4}(?![\d.])|(?:[1-4]|I{1,3}|IV)\s*(?:квартал\w*|кв\.)\s*\d{4}" + YEAR_TAIL
)
DATE_RANGE = NOT_AFTER_LETTER + r"(?:с|по|до)\s+(\d{1,2}\.\d{1,2})(?![.\d/])"

# Characters that are trimmed from both ends of a match.
TRIM = " \t.,;:!?)(»«\"'=|/\\_-"
TRIM_DATE = " \t,;:!?)(=|/\\_-"

# Placeholders and residual checks.
PLACEHOLDER = r"\[([A-Z_]+)_(\d+)\]"
PLACEHOLDER_ANY = r"\[[A-ZА-ЯЁ_]+_\d+\]"
LONG_DIGITS = r"(?<![\d\w])\d(?:[ \t.\-]?\d){9,}(?![\d\w])"
EMAIL_LIKE = r"[A-Za-zА-Яа-яЁё0-9._%+\-]+\s?@\s?[A-Za-zА-Яа-яЁё0-9.\-]+\.[A-Za-zА-Яа-яЁё]{2,}"

# The weight of a label where spans overlap; 0 for others.
PRIORITY = {
    "CUSTOM_TERM": 95, "EMAIL": 90, "URL": 90, "IP_ADDRESS": 90, "ACCOUNT": 88, "MEDICAL": 84, "STAFF_ID": 78, "POSTAL_CODE": 52,
    "PASSPORT": 80, "SNILS": 80, "INN": 80, "OMS": 80, "DRIVER_LICENSE": 80, "MILITARY_ID": 80, "BIRTH_CERTIFICATE": 80,
    "CREDIT_CARD": 70, "BANK_ACCOUNT": 82, "KPP": 80, "OGRN": 80, "BIK": 85, "OKPO": 85, "OKVED": 85, "OKTMO": 85, "OKATO": 85,
    "VIN": 84, "PLATE": 84, "CADASTRE": 84, "CONTRACT": 65, "ORG": 62, "SENSITIVE": 55, "SUBJECT": 56, "ADMIN_CODE": 60, "FILE": 58,
    "AMOUNT": 55, "DATE": 45, "PHONE": 40, "FIRST_NAME": 60, "LAST_NAME": 60, "MIDDLE_NAME": 60, "COUNTRY": 50, "REGION": 50,
    "DISTRICT": 50, "CITY": 50, "STREET": 50, "HOUSE": 50,
}

# Label families.
SOFT_LABELS = frozenset("PERSON ORG LOCATION CITY REGION COUNTRY DISTRICT STREET HOUSE ADDRESS FIRST_NAME LAST_NAME MIDDLE_NAME".split())
PLACE_LABELS = SOFT_LABELS - frozenset("PERSON FIRST_NAME LAST_NAME MIDDLE_NAME".split())
CASE_LABELS = frozenset({"PERSON", "LOCATION", "ORG"})
MERGED_LABELS = frozenset({"ORG", "LOCATION"})
REVIEWABLE_LABELS = SOFT_LABELS | {"ADMIN_CODE", "SUBJECT"}
MODEL_SOURCES = frozenset({"gliner", "ner", "llm", "llm2", "llm-recall"})

# Word lists of the filters (stems match as beginnings of words).
ROLE_STEMS = (
    "директор бухгалтер менеджер архитектор аналитик начальник руководител специалист инженер заместител помощни секретар "
    "кладовщик логист экономист юрист кассир оператор программист разработчик консультант продав водител технолог маркетолог "
    "снабжен диспетчер бригадир мастер отдел служб департамент директора сотрудник персонал"
).split()
MODIFIER_STEMS = (
    "генеральн финансов главн старш младш ведущ исполнительн коммерческ техническ региональн функциональн системн ит it по "
    "продаж закуп логистик кадр склад и новой новый управленческ"
).split()
GENERIC_TITLES = frozenset("должность должности этап срок сроки описание участник участники ответственный заказчик исполнитель тема повестка".split())
CONTRACT_ROLE_STEMS = (
    "заказчик исполнител подрядчик субподрядчик сторон покупател поставщик продавц продавец арендатор арендодател лицензиат "
    "лицензиар страховател страховщик займодавц займодавец заимодавц заемщик заёмщик кредитор должник принципал комитент "
    "комиссионер поверенн доверител получател плательщик грузоотправител грузополучател работодател работник правообладател"
).split()
SOFTWARE = "1с 1c excel word outlook foxpro контур диадок sap oracle битрикс sku ebitda гтд эдо edi erp crm bi sql 1с:erp".split()
STOPWORDS = frozenset(
    (
        "я ты он она оно они мы вы меня тебя его её ее нас вас их мне тебе ему ей нам вам им них нему нею ней мной мною тобой "
        "тобою нами вами ими себя себе собой собою это этот эта эти тот та те то той том этом вот тут там здесь тогда сейчас "
        "теперь да нет ну же бы ли не ни уж и а но или что чтобы как так чем кто где когда куда зачем почему мой твой наш ваш "
        "свой весь вся всё все ага угу вообще просто значит"
    ).split()
)
REQUISITE_WORDS = frozenset(
    ["инн", "кпп", "огрн", "огрнип", "бик", "окпо", "октмо", "окато", "оквэд", "снилс", "омс", "р/с", "к/с", "л/с", "расчётный счёт",
     "расчетный счёт", "расчетный счет", "корр. счёт", "корр. счет", "юридический адрес", "реквизиты", "реквизиты банка"]
)
MONEY_CUES = "руб рубл ₽ $ € долл евро млн млрд тыс миллион миллиард тысяч копе цент".split()
NOISE_STEMS = (
    "человек люд команд компани клиент проект систем ассистент нейросет модел решени лаборатори пользовател ведущ смежник "
    "сотрудник персонал коллег ребят друзь заказчик исполнител искусственн интеллект данн документ протокол встреч вопрос "
    "задач инструмент процесс результат коммент отдел служб групп функционал сегодн завтра вчера штук вариант момент вещ"
).split()
COMMON_NOUNS = frozenset(
    "нейросеть ассистент компания команда система проект решение интеллект пользователь ведущий заказчик исполнитель документ протокол встреча вопрос задача".split()
)
PREPOSITIONS = frozenset("у в во на с со к ко о об от до из по за для при над под про без из-за через".split())
INTERJECTIONS = frozenset("так ну вот ага угу эээ ммм да нет ок окей блин короче значит типа это вообще просто ладно".split())
GENERIC_ENTITIES = frozenset(
    (
        "заказчик исполнитель подрядчик поставщик клиент участник участники представитель представители сотрудник сотрудники "
        "коллега коллеги спикер директор руководитель начальник специалист аналитик команда команды сторона стороны "
        "пользователь организация организации учреждение учреждения компания компании фирма предприятие отдел департамент "
        "служба офис филиал подразделение город область район адрес чат чате чата протокол договор проект система программа документ"
    ).split()
)
CASE_ENDINGS = "иями иях ами ями ах ях ом ем ём ой ей им ым у ю е и ы а я".split()
EDGE_PUNCTUATION = "«»\"'“”‘’.,;:!?()[]{}<>—–-№"
TIMECODE = r"\d{1,2}:\d{2}(?::\d{2})?"
SPEAKER = r"(?:спикер|speaker|участ\w*|трек|track)\s*[№#]?\s*\d+"
REPEATED = r"(\w{1,6})(?:[\-\s]+\1){1,}"

# Names of types in model replies.
REPLY_TYPES = {
    "FIRST_NAME": "PERSON", "LAST_NAME": "PERSON", "MIDDLE_NAME": "PERSON", "NAME": "PERSON", "PER": "PERSON", "COUNTRY": "LOCATION",
    "REGION": "LOCATION", "DISTRICT": "LOCATION", "CITY": "LOCATION", "STREET": "LOCATION", "HOUSE": "LOCATION", "ADDRESS": "LOCATION",
    "LOC": "LOCATION", "ORGANIZATION": "ORG", "COMPANY": "ORG", "ORG": "ORG", "AMOUNT": "AMOUNT", "MONEY": "AMOUNT", "SUM": "AMOUNT",
    "PRICE": "AMOUNT", "SUBJECT": "SUBJECT", "GOODS": "SUBJECT", "PRODUCT": "SUBJECT", "ITEM": "SUBJECT", "SERVICE": "SUBJECT",
    "PRODUCT_NAME": "SUBJECT",
}
REPLY_LABELS = frozenset(
    "PERSON LOCATION PHONE EMAIL URL IP_ADDRESS CREDIT_CARD INN SNILS OMS PASSPORT DRIVER_LICENSE MILITARY_ID BIRTH_CERTIFICATE".split()
)
REPLY_STOPWORDS = frozenset(
    "паспорт паспорта снилс инн омс полис серия серии номер номера телефон телефона почта почты адрес email e-mail имя фамилия отчество дата".split()
)
RECALL_LABELS = frozenset(
    (
        "PERSON ORG LOCATION ADDRESS CITY REGION STREET HOUSE DATE PHONE EMAIL URL IP_ADDRESS AMOUNT INN SNILS OGRN OKPO KPP BIK "
        "BANK_ACCOUNT CONTRACT PASSPORT MILITARY_ID CREDIT_CARD ADMIN_CODE OMS DRIVER_LICENSE BIRTH_CERTIFICATE SUBJECT"
    ).split()
)
RECALL_TYPES = {
    "NAME": "PERSON", "FULL_NAME": "PERSON", "FULLNAME": "PERSON", "FIO": "PERSON", "PERSON_NAME": "PERSON", "COMPANY": "ORG",
    "ORGANIZATION": "ORG", "ORGANISATION": "ORG", "COMPANY_NAME": "ORG", "ORGANIZATION_NAME": "ORG", "PHONE_NUMBER": "PHONE",
    "PHONENUMBER": "PHONE", "TELEPHONE": "PHONE", "TEL": "PHONE", "MOBILE": "PHONE", "MOBILE_PHONE": "PHONE", "E_MAIL": "EMAIL",
    "MAIL": "EMAIL", "EMAIL_ADDRESS": "EMAIL", "FULL_ADDRESS": "ADDRESS", "ADDRESS_FULL": "ADDRESS", "POSTAL_ADDRESS": "ADDRESS",
    "BIRTH_DATE": "DATE", "BIRTHDATE": "DATE", "DOB": "DATE", "ACCOUNT": "BANK_ACCOUNT", "ACCOUNT_NUMBER": "BANK_ACCOUNT",
    "BANK_ACCOUNT_NUMBER": "BANK_ACCOUNT", "IBAN": "BANK_ACCOUNT", "TAX_ID": "INN", "TAXPAYER_ID": "INN", "INN_NUMBER": "INN",
    "OGRN_NUMBER": "OGRN", "PASSPORT_NUMBER": "PASSPORT", "PASSPORT_NO": "PASSPORT", "SNILS_NUMBER": "SNILS", "SUM": "AMOUNT",
    "MONEY": "AMOUNT", "PRICE": "AMOUNT", "SALARY": "AMOUNT", "PLACE": "LOCATION", "GEO": "LOCATION", "WEBSITE": "URL", "SITE": "URL",
    "LINK": "URL",
}
COARSE_LABELS = {
    "FIRST_NAME": "PERSON", "LAST_NAME": "PERSON", "MIDDLE_NAME": "PERSON", "COUNTRY": "LOCATION", "REGION": "LOCATION",
    "DISTRICT": "LOCATION", "CITY": "LOCATION", "STREET": "LOCATION", "HOUSE": "LOCATION",
}
