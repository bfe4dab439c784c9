"""spark-submit entry: mask or restore tables.

python -m maskwright mask IN OUT [--mapping OUT] [--id doc_id] [--text text] [--corporate/--no-corporate] [--dates] [--glossary FILE]
python -m maskwright restore MASKED MAPPING OUT [--id doc_id]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.extract import restored
from .operators import glossary
from .plans.masking import PipelineConfig, mask_documents


def main() -> None:
    p = argparse.ArgumentParser(prog="maskwright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    m = sub.add_parser("mask")
    m.add_argument("source")
    m.add_argument("out")
    m.add_argument("--mapping", help="where the mapping goes; without it none is written")
    m.add_argument("--id", default="doc_id")
    m.add_argument("--text", default="text")
    m.add_argument("--corporate", action=argparse.BooleanOptionalAction, default=True)
    m.add_argument("--dates", action="store_true")
    m.add_argument("--glossary")
    r = sub.add_parser("restore")
    r.add_argument("masked")
    r.add_argument("mapping")
    r.add_argument("out")
    r.add_argument("--id", default="doc_id")
    a = p.parse_args()
    spark = SparkSession.builder.appName("maskwright").getOrCreate()
    if a.what == "mask":
        terms = glossary.load(spark, a.glossary) if a.glossary else glossary.parse(glossary.DEFAULT_TERMS)
        config = PipelineConfig(corporate=a.corporate, dates=a.dates, terms=terms, irreversible=a.mapping is None)
        results = mask_documents(spark.read.parquet(a.source), config, a.id, a.text)
        # Both sinks read one evaluation.
        results = results.persist()
        results.select(a.id, "masked", "summary", "preexisting").write.mode("overwrite").parquet(a.out)
        if a.mapping is not None:
            results.select(a.id, "mapping").write.mode("overwrite").parquet(a.mapping)
    else:
        both = spark.read.parquet(a.masked).join(spark.read.parquet(a.mapping), a.id)
        both.select(a.id, restored(F.col("masked"), F.col("mapping")).alias("text")).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
