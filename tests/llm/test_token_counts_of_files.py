"""Starts of documents come from stored numbers of ids: counting a file's ids decodes none of them."""

import public_tokenizers
from pyspark.sql import functions as F

from cutline.llm import token_files


def test_file_bases_read_no_ids(spark, tmp_path):
    path = str(tmp_path / "ids")
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"words of text {i} " * (i % 4)) for i in range(40)], "doc_id long, text string")
    token_files.write_token_files(df, path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_files.read_token_files(spark, path)
    assert rows.where(F.col("n_ids") != F.size("ids")).count() == 0
    out = token_files.token_digests(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan
    at = 0
    for r in out.orderBy("doc_id").collect():
        assert r.start == at
        at += r.n_tokens
