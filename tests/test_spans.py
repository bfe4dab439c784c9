"""Span algebra, filters, propagation, glossary, chunking, review."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.operators import filters as Fi
from maskwright.operators import glossary as G
from maskwright.operators import providers as Pr
from maskwright.operators import review as R
from maskwright.operators import spans as S
from maskwright.operators.chunking import chunks
from maskwright.plans.masking import PipelineConfig, mask, residual


def test_balanced():
    t = "«12» сентября"
    assert S.balanced(t, 1, len(t)) == (0, len(t))
    t = "Технопарка «Сколково» тут"
    assert t[slice(*S.balanced(t, 0, 20))] == "Технопарка «Сколково»"
    t = "Альфа-Банк (АО)"
    assert S.balanced(t, 0, len(t) - 1) == (0, len(t))


def test_resolve_order_and_weight():
    a, b, c = S.Span(0, 5, "PHONE", "x"), S.Span(3, 6, "INN", "y"), S.Span(3, 6, "KPP", "z")
    assert S.resolve([a, b, c]) == [b]
    assert S.resolve([a, c, b]) == [c]


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9), st.sampled_from(["INN", "PHONE", "PERSON"])), max_size=20))
@settings(max_examples=60, deadline=None)
def test_resolve_is_disjoint_and_maximal(parts):
    every = [S.Span(a, a + n, label, "x") for a, n, label in parts]
    kept = S.resolve(every)
    assert all(p.end <= q.start for p, q in zip(kept, kept[1:], strict=False))
    assert all(any(S.overlap((s.start, s.end), (k.start, k.end)) for k in kept) for s in every)


def test_merge_and_number():
    spans = [S.Span(0, 5, "ORG", "Форус"), S.Span(6, 12, "ORG", "Форуса"), S.Span(13, 19, "PERSON", "Иванов"), S.Span(20, 27, "PERSON", "Иванова")]
    merged = S.merge_forms(spans)
    assert merged[0].merge_key == merged[1].merge_key and merged[1].canonical == "Форус" and merged[2].merge_key is None
    mapping, names = S.number(merged)
    assert names == ["[ORG_1]", "[ORG_1]", "[PERSON_1]", "[PERSON_2]"] and mapping["[ORG_1]"] == "Форус"
    assert S.number(merged, {"PERSON": 4})[1][2] == "[PERSON_5]"


def test_substitution_is_by_token():
    text = "Ян сегодня у Яна: Ян."
    masked, found = S.substitute(text, [S.Span(0, 2, "PERSON", "Ян")], ["[PERSON_1]"])
    assert masked == "[PERSON_1] сегодня у Яна: [PERSON_1]." and len(found) == 2
    assert S.substitute(text, [S.Span(0, 2, "PERSON", "Ян")], ["[PERSON_1]"], everywhere=False)[0] == "[PERSON_1] сегодня у Яна: Ян."


def test_case_forms():
    text = "Мингосом сказано, что Мингос и Мингосу."
    assert [s.text for s in S.case_forms(text, [S.Span(0, 8, "ORG", "Мингосом")])] == ["Мингос", "Мингосу"]


def test_filters():
    assert Fi.is_job_title("Главный бухгалтер") and not Fi.is_job_title("Иванов")
    assert Fi.is_contract_role("Исполнителя") and Fi.is_software("1С:ERP")
    assert Fi.is_stopword("он", "PERSON") and not Fi.is_stopword("он", "INN")
    assert Fi.is_noise("12:30", "INN") and Fi.is_noise("1", "PASSPORT") and Fi.is_noise("Спикер 4", "PERSON") and Fi.is_noise("так-так-так", "PERSON")
    assert not Fi.is_noise("Иванов Иван", "PERSON") and Fi.is_noise("это всё равно", "PERSON")
    assert Fi.is_common_phrase("новой системы", "ORG") and not Fi.is_common_phrase("Форус", "ORG")
    assert Fi.is_money("18% годовых") and not Fi.is_money("22 ТС")
    assert Fi.is_generic(S.Span(0, 10, "ORG", "учреждению")) and not Fi.is_generic(S.Span(0, 5, "ORG", "Форус"))


def test_glossary():
    terms = G.parse("Мингос, МГУ = Министерство # note\nплохая строка\n= пусто\nОдин = ")
    assert [(t.canonical, t.aliases) for t in terms] == [("Министерство", ("Мингос", "МГУ")), ("Один", ("Один",))]
    found = G.detector(G.parse("Правительство = Правительство"))("правительством и Правительства, неправительство")
    assert [s.text for s in found] == ["правительством", "Правительства"]


@given(st.text(alphabet="аб \n", max_size=80), st.integers(1, 20), st.booleans())
@settings(max_examples=100, deadline=None)
def test_chunks(text, size, group):
    parts = chunks(text, size, group)
    assert all(text[a : a + len(c)] == c and c.strip() for a, c in parts)
    assert re.sub(r"\s", "", text) == re.sub(r"\s", "", "".join(c for _, c in parts))


def test_replies():
    assert Pr.reply_items("PERSON|Иван\n```\nEMAIL|a@b") == [("Иван", "PERSON"), ("a@b", "EMAIL")]
    assert Pr.last_array('a [1] b [{"text": "x]"}] c') == '[{"text": "x]"}]'
    assert Pr.reply_items('so [1] then [{"text":"Иван","type":"NAME"}]') == [("Иван", "NAME")]
    assert Pr.reply_label("first-name") == "PERSON" and Pr.reply_label("") == "PERSON" and Pr.recall_label("phone number") == "PHONE"
    assert Pr.locate("Иван  Петров", "Иван Петров") == [(0, 12)] and Pr.locate("a", "b") == []


class Chat:
    def __init__(self, *replies):
        self.replies = list(replies)

    def complete(self, system, user):
        return self.replies.pop(0)


def test_chat_detector_retries_and_warns():
    assert [s.text for s in Pr.ChatDetector(Chat("", "PERSON|Иван"))("Тут Иван")] == ["Иван"]
    warnings = []
    assert Pr.ChatDetector(Chat("", ""))("Тут Иван", warnings) == [] and warnings[0]["kind"] == "llm_chunk_failed"
    assert Pr.ChatDetector(Chat("NONE"))("Тут Иван") == []


def test_retry_only_server_errors_and_trips():
    class Status(Exception):
        def __init__(self, status):
            self.status = status

    calls = []

    def fail(status):
        calls.append(status)
        raise Status(status)

    r = Pr.Retry(fail, sleep=lambda s: None, trip=2)
    for status, n in ((500, 3), (400, 4)):
        try:
            r(status)
        except Status:
            pass
        assert len(calls) == n
    try:
        r(500)
        raise AssertionError("not refused")
    except ConnectionError:
        pass


class Names:
    def is_known(self, word):
        return word in ("День", "Спикер", "Иван")

    def is_name(self, word):
        return word == "Иван"


def test_unmask_gate():
    assert not R.may_unmask("День", None)
    assert R.may_unmask("День", Names()) and R.may_unmask("Ааа", Names()) and R.may_unmask("ТЗ", Names()) and R.may_unmask("Ив-2", Names())
    for word in ("Вайгус", "Яков", "ИВАНОВ", "Римский-Корсаков", "Ивэ", "Иван"):
        assert not R.may_unmask(word, Names())


def test_review_rules():
    text = "День и Капитан Яков, Вайгус. Форус"
    spans = [S.Span(0, 4, "PERSON", "День", "llm"), S.Span(7, 19, "PERSON", "Капитан Яков", "llm"), S.Span(21, 27, "PERSON", "Вайгус", "llm"), S.Span(29, 34, "ORG", "Форус", "regex")]
    asked = R.candidates(text, spans)
    assert len(asked) == 3
    reply = '[{"id":0,"text":"День","keep":false},{"id":2,"text":"вайгус","merge_with":1},{"id":1,"text":"другое","keep":false},{"id":9,"text":"x"}]'
    out = R.apply_verdicts(text, spans, asked, R.verdicts(reply, list(asked.values())), Names())
    assert [s.text for s in out] == ["Капитан Яков", "Вайгус", "Форус"]
    assert out[0].merge_key == out[1].merge_key and out[1].canonical == "Капитан Яков"
    assert R.judge_numbers("код 777", [S.Span(4, 7, "ADMIN_CODE", "777")], lambda q: {}) == []


def test_recall_and_review_in_plan():
    config = PipelineConfig(providers=(lambda t: [S.Span(0, 6, "PERSON", "Вайгус", "llm")] if t.startswith("Вайгус") else [],), review=lambda p: 1 / 0, recall=lambda p: '[{"text":"Лапин","type":"NAME"},{"text":"xyz","type":"ALIEN"}]')
    r = mask("Вайгус и Лапин xyz", config)
    assert r.masked == "[PERSON_1] и [PERSON_2] xyz" and "review_failed" in {w["kind"] for w in r.warnings}


def test_leak_check():
    r = mask("Секрет Зорин", PipelineConfig(leak_check=(lambda t: [S.Span(t.index("Зорин"), t.index("Зорин") + 5, "PERSON", "Зорин")] if "Зорин" in t else [],)))
    assert r.masked == "Секрет [PERSON_1]" and r.spans[0].source == "llm2"


def test_residual():
    found = residual("ИНН 771122233344 и [INN_1234567890], a@b.ru")
    assert [(w["kind"], w["value"]) for w in found] == [("DIGITS", "771122233344"), ("EMAIL", "a@b.ru")]


@given(st.text(alphabet="абвИО .@1234567890-+\n[]_", max_size=120))
@settings(max_examples=80, deadline=None)
def test_plan_properties(text):
    r = mask(text, PipelineConfig())
    assert all(p.end <= q.start for p, q in zip(r.spans, r.spans[1:], strict=False))
    assert all(text[s.start : s.end] == s.text for s in r.spans)
    assert all(k in r.masked for k in r.mapping)


def test_second_questions():
    """A dropped person beside a kept one is asked for again (no answer: masked); a short number without an answer is unmasked."""
    persons = lambda t: [S.Span(0, 4, "PERSON", "День", "llm"), S.Span(5, 11, "PERSON", "Вайгус", "llm")] if t.startswith("День Вайгус") else []
    numbers = lambda t: [S.Span(t.index("777"), t.index("777") + 3, "ADMIN_CODE", "777", "llm")] if "777" in t else []

    def config(*replies):
        left = list(replies)
        return PipelineConfig(providers=(persons, numbers), names=Names(), review=lambda p: left.pop(0) if left else "[]")

    text = "День Вайгус, код 777"
    drop = '[{"id":0,"text":"День","keep":false}]'
    assert mask(text, config(drop)).masked == "[PERSON_1] [PERSON_2], код 777"
    assert mask(text, config(drop, '[{"id":0,"text":"День","mask":false}]', '[{"id":0,"text":"777","mask":true}]')).masked == "День [PERSON_1], код [ADMIN_CODE_1]"
