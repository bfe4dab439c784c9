"""DataFrame operators: masking, restoring, evaluation, usage, readers, streaming."""

import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.functions import extract as X
from maskwright.operators import evaluation as E
from maskwright.operators import spans as S
from maskwright.operators import usage as U
from maskwright.plans.masking import PipelineConfig, mapping_rows, mask_documents, without_mapping
from maskwright.rules import BY_NAME
from maskwright.sources import readers
from maskwright.streaming.masking import mask_stream

TEXTS = [(1, "Почта a@b.ru, тел. +7 (914) 123-45-67."), (2, None), (3, ""), (4, "ИНН 7711222333 🙂 d@e.com и a@b.ru"), (4, "повтор")]


def test_mask_documents(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("masked", F.lit("clash"))
    rows = mask_documents(docs).collect()
    assert len(rows) == 5 and sum(r.masked is None for r in rows) == 1
    assert next(r for r in rows if r.doc_id == 1).masked == "Почта [EMAIL_1], тел. [PHONE_1]."
    assert mapping_rows(mask_documents(docs)).count() == 5
    hidden = mask_documents(docs, PipelineConfig(irreversible=True))
    assert hidden.where(F.size("mapping") > 0).count() == 0 and hidden.where(F.exists("spans", lambda s: s["text"].isNotNull())).count() == 0
    assert "mapping" not in without_mapping(rows and mask_documents(docs)).columns
    assert mask_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["EMAIL", "CREDIT_CARD", "IP_ADDRESS", "PHONE", "INN", "KPP", "POSTAL_ADDR", "ADMIN_CODE_STAMP", "SNILS_KW", "CITY", "VIN"])
def test_native_spans_equal_python(spark, name):
    texts = ["🙂 a@b.ru, x . y@z . com", "4276 3800 1234 5678 и 4276380012345678", "ip 10.0.0.1. и 192.168.1.45", "+7 914 123 45 67; (3952) 405-000", "ИНН 7711222333, ИНН: 12-34", "КПП 771101001 КПП 12345", "101000, г. Москва; 664003, Иркутская обл", "штамп отдела (И-118):", "СНИЛС 112-233-445 95", "г. Иркутск, с. Оёк", "XTA210990Y2765432", "", "нет"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    got = {(r.k, r.s.start, r.s.end, r.s.text) for r in df.select("k", F.explode(X.spans(F.col("text"), BY_NAME[name])).alias("s")).collect()}
    rule = BY_NAME[name]
    want = set()
    for k, t in enumerate(texts):
        for m in rule.regex.finditer(t):
            a, b = S.trimmed(t, *m.span(rule.groups[0]), rule.strip)
            if a < b:
                want.add((k, a, b, t[a:b]))
    assert got == want


def test_restore(spark):
    df = spark.createDataFrame([("[PERSON_1] и [PERSON_10] в [CITY_1]", {"[PERSON_1]": "Ян", "[PERSON_10]": "Як"})], "masked string, mapping map<string,string>")
    r = df.select(X.restored(F.col("masked"), F.col("mapping")).alias("a"), X.unknown_placeholders(F.col("masked"), F.col("mapping")).alias("u"), X.partly_restored(F.col("masked"), F.col("mapping"), F.array(F.lit("[PERSON_1]"))).alias("p")).first()
    assert r.a == "Ян и Як в [CITY_1]" and r.u == ["[CITY_1]"] and r.p == "Ян и [PERSON_10] в [CITY_1]"
    with pytest.raises(Exception, match="unresolved"):
        df.select(X.restored_strict(F.col("masked"), F.col("mapping"))).collect()
    assert df.select(X.is_placeholder(F.lit("[A_1]")), X.is_placeholder(F.lit("x[A_1]"))).first()[:] == (True, False)
    assert df.select(X.mapping_from_json(X.mapping_json(F.col("mapping"))).alias("m")).first().m["[PERSON_1]"] == "Ян"
    s = df.select(X.sniffed(F.lit("Иван Петров 1234567 a@b.c")).alias("s")).first().s
    assert s["capitals"] == ["Иван Петров"] and s["digits"] == ["1234567"] and s["email"] == ["a@b.c"]


def test_resolved_native(spark):
    found = [(0, 5, "PHONE", "a", "regex"), (3, 6, "INN", "b", "regex"), (8, 9, "KPP", "c", "regex")]
    df = spark.createDataFrame([(found,)], "s array<struct<start:int,end:int,label:string,text:string,source:string>>")
    assert [x.text for x in df.select(X.resolved(F.col("s")).alias("r")).first().r] == ["b", "c"]


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, "Иван Петров живёт в Москве Иван", ["Иван", "Петров", "живёт", "в", "Москве", "Иван"], ["B-FIRST_NAME", "I-LAST_NAME", "O", "O", "B-CITY", "B-FIRST_NAME"]), (2, "x", ["x"], [])], "row long, text string, tokens array<string>, ner_tags array<string>")
    gold = E.gold_spans(rows)
    assert {(r.start, r.end, r.category) for r in gold.collect()} == {(0, 11, "PERSON"), (20, 26, "LOCATION"), (27, 31, "PERSON")}
    pred = spark.createDataFrame([(1, 0, 4, "PERSON"), (1, 5, 11, "PERSON"), (1, 20, 26, "PERSON")], "row long, start int, end int, category string")
    assert {(r.start, r.end) for r in E.merge_adjacent(pred).collect()} == {(0, 11), (20, 26)}
    found = E.matches(gold, E.merge_adjacent(pred))
    all_ = {r["name"]: r for r in E.scores(found).collect()}
    assert all_["ALL"].n_gold == 3 and all_["ALL"].gold_hit == 1 and all_["ALL"].pred_hit == 1 and all_["ALL"].missed == 1
    assert {(r.kind, r.category) for r in E.errors(found).collect()} == {("MISMATCH", "LOCATION"), ("TRUEMISS", "PERSON"), ("FP", "PERSON")}
    assert E.compare(E.scores(found), E.scores(found)).where("f1_delta <> 0").count() == 0


def test_usage(spark, tmp_path):
    calls = spark.createDataFrame([("r", "gliner", 73321, 1.0, 0, 0)] + [("r", "gliner", 0, 0.1, 0, 0)] * 355 + [("r", "llm_detect", 0, 2.0, 160681, 2321)], "request_id string, kind string, chars long, seconds double, prompt_tokens long, completion_tokens long")
    now = datetime.datetime(2026, 1, 10, tzinfo=datetime.timezone.utc)
    reqs = spark.createDataFrame([("r", "2026-01-10T01:00:00+00:00", "f.txt", 73321, 60.0, {"ner": True}), ("q", "bad", "g", 1800, 1.0, {})], "request_id string, ts string, filename string, chars long, seconds double, stages map<string,boolean>")
    totals = U.request_totals(calls, reqs)
    r = totals.where("request_id = 'r'").first()
    assert r.cost_rub_llm == 2.4766 and r.gliner_tokens_est == 39420 and r.pages == 40.7 and r.calls["gliner"] == 356
    path = str(tmp_path / "log")
    U.append_log(totals, path)
    spark.createDataFrame([("{broken",), ('{"kind":"call"}',), ('{"kind":"request_total","calls":5,"ts":"x"}',)], "value string").write.mode("append").text(path)
    read = U.read_totals(spark, path)
    assert read.count() >= 2
    periods = {r.period: r for r in U.summary(totals, now).collect()}
    assert periods["today"].requests == 1 and periods["all_time"].requests == 2 and periods["last_30_days"].cost_rub_llm == 2.4766
    assert {r.kind: r.calls for r in U.by_stage(read).collect()}["llm_detect"] == 1
    assert U.to_log(calls.withColumn("ok", F.lit(True)), "errors").count() == 0


def test_load(spark):
    rows = [(1, 60.0, 1800.0, 0.1, float(k), "done", None) for k in range(1, 101)] + [(2, 60.0, 1800.0, 0.1, 1.0, "done" if k < 8 else "error", None) for k in range(10)]
    rows += [(3, 60.0, 1800.0, 0.1, 1.0, "timeout", 503 if k == 0 else None) for k in range(4)] + [(4, 60.0, 1800.0, 0.1, 1.0, "done", None)]
    levels = U.load_levels(spark.createDataFrame(rows, "level int, duration double, doc_chars double, submit_latency double, wait_time double, status string, http_status int"))
    by = {r.level: r for r in levels.collect()}
    assert abs(by[1].wait_p95 - 95.05) < 1e-9 and by[1].docs_per_min == 100 and by[2].abort_reason is None and by[3].abort_reason == "http_5xx"
    assert [r.level for r in U.ramp(levels).orderBy("level").collect()] == [1, 2, 3]


def test_audit(spark):
    r = spark.createDataFrame([("t", "r", "имя.docx", {"INN": 2}, 10, 1.0, True, None)], "ts string, request_id string, filename string, summary map<string,int>, chars long, seconds double, ok boolean, error_type string")
    a = U.audit_operations(r, "me", "regex").first()
    assert a.replacements_total == 2 and len(a.source_ref) == 16 and "filename" not in a.asDict()


def _docx(*paragraphs):
    w = readers.WORD_NS.strip("{}")
    body = "".join(f"<w:p><w:r><w:t>{p[:3]}</w:t></w:r><w:r><w:t>{p[3:]}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        box.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
        box.writestr("word/header1.xml", f'<w:hdr xmlns:w="{w}"><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>')
    return out.getvalue()


def test_readers(spark, tmp_path):
    data = _docx("Иван Петров", "x")
    assert readers.text_of("a.docx", data) == "Иван Петров\nx\na\tb\nhead"
    assert readers.docx(readers.docx_rebuilt(data, {"Иван Петров": "[PERSON_1]"})).startswith("[PERSON_1]\nx")
    assert readers.text_of("a.xml", b"<a>x<b>y</b></a>") == "x\ny"
    assert readers.text_of("a.rtf", rb"{\rtf1\ansi \'cf\'f0\par ok}") == "Пр\nok"
    assert readers.text_of("a.txt", "привет".encode("cp1251")) == "привет"
    for name, body in (("a.txt", "текст".encode()), ("b.docx", data), ("c.pptx", b"x"), ("d.docx", b"broken")):
        (tmp_path / name).write_bytes(body)
    rows = {r.name: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "текст" and rows["b.docx"].text.startswith("Иван") and rows["c.pptx"].error and rows["d.docx"].text is None


def test_mask_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx("Носов Д.В. пишет", "x"))
    (tmp_path / "b.pptx").write_bytes(b"x")
    rows = {r.path.rpartition("/")[2]: r for r in readers.mask_files(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].masked.startswith("[PERSON_1]") and readers.docx(rows["a.docx"].rebuilt).startswith("[PERSON_1]")
    assert rows["b.pptx"].error and rows["b.pptx"].masked is None


def test_restore_one(tmp_path):
    from maskwright import load_mapping, mask, restore, save_mapping, unknown

    text = "Почта a@b.ru, ИНН 7711222333."
    r = mask(text, PipelineConfig())
    save_mapping(r.mapping, tmp_path / "m.json")
    assert restore(r.masked, load_mapping(tmp_path / "m.json"), strict=True) == text
    assert unknown("[CITY_1] неизвестен.", {}) == ["[CITY_1]"] and restore("[CITY_1]", {}) == "[CITY_1]"
    with pytest.raises(KeyError):
        restore("[CITY_1]", {"[A_1]": "x"}, strict=True)


def test_benchmark_and_forms(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text('text,tokens,ner_tags\n"a, b","[""a"",""b""]","[""O"",""B-CITY""]"\n', encoding="utf-8")
    r = readers.read_benchmark(spark, str(p)).first()
    assert r.tokens == ["a", "b"] and r.ner_tags[1] == "B-CITY"
    forms = spark.createDataFrame([("_____ " * 40,), ("Иванов И.И. ИНН 7711222333, 01.02.2025, 500 руб. " * 5,)], "text string")
    assert [x.filled for x in readers.form_features(forms).collect()] == [False, True]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    mask_stream(stream, str(tmp_path / "out"), str(tmp_path / "map"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted((r.doc_id, r.masked or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.doc_id, r.masked or "") for r in mask_documents(docs).collect())
    assert spark.read.parquet(str(tmp_path / "map")).where(F.size("mapping") > 0).count() == 2


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert json.dumps(sorted(entry.queries()))
