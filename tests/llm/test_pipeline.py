"""The pipeline's stages on a small corpus: what they drop, keep and change."""

import pytest

from tests.llm.test_llm import prose

pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    passage = prose(60, 1)
    rows = [(k, prose(80, 100 + k), "en", "s", 0) for k in range(30)]
    rows += [(40, rows[0][1], "en", "s", 0), (41, f"{prose(100, 7)} {passage} {prose(100, 8)}", "en", "s", 0), (42, f"{prose(80, 9)} a@b.com {prose(30, 10)}", "en", "s", 0), (43, "123 456", "en", "s", 0), (44, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(P.STAGES) == 5
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, str(tmp_path)), "stage")
        seen[name] = {x.doc_id: x for x in docs.collect()}
    first, near, clean, private, last = seen.values()
    assert set(first) == {k for k, *_ in rows} - {43, 44} and set(near) == set(first) - {40}
    assert set(clean) == set(near) and passage not in clean[41].text and clean[3].text == rows[3][1] and clean[41].n_chars == len(clean[41].text)
    assert "[EMAIL]" in private[42].text and "a@b.com" not in private[42].text
    assert set(last) == set(near) and all(x.round_trip for x in last.values())
    assert P.run(spark, str(tmp_path)).count() == len(last)
