"""Arrow batches of texts are bounded in bytes, not only in rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from askgrade.llm import common


def test_long_texts_come_in_batches_of_few_bytes(spark):
    texts = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    @F.arrow_udf("long")
    def held(batch: pa.Array) -> pa.Array:
        return pa.array([len(batch)] * len(batch), pa.int64())

    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        most = common.small_batches(texts).select(held("text").alias("n")).agg(F.max("n")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert most * 100_000 <= common.BATCH_BYTES + 100_000
