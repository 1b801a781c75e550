"""Identity at scale: texts are spread over all tasks, and are cut as ``split`` would cut them."""

import pytest
from pyspark.sql import functions as F

from metricledger.functions.expr_tools import split_at
from metricledger.operators import enrich


def test_few_bytes_of_texts_fill_all_tasks(spark, tmp_path):
    log = spark.range(2_000).select(F.concat(F.lit("rate(m_"), "id", F.lit("[5m])")).alias("query_param"))
    stored = enrich.stored_dictionary(log, str(tmp_path / "words"))
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 2_000


@pytest.mark.parametrize("text", ["", "a", "a , b", " , ", "a , b , ", "⟨v0:⟩ + ⟨p1:V⟩"])
@pytest.mark.parametrize("pattern", [" , ", r"⟨[a-z]\d+:\w*⟩"])
def test_split_at_is_split(spark, text, pattern):
    row = spark.createDataFrame([(text,)], "t string").select(split_at(F.col("t"), pattern).alias("a"), F.split("t", pattern, -1).alias("b")).first()
    assert row.a == row.b
