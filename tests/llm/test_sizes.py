"""What readers and tasks hold at once does not grow with the tables."""

import pyarrow.parquet as pq

from tessella.llm import common, decontaminate, textnum


def test_files_of_the_index_hold_few_segments(spark):
    """A reader takes a file's segments together, so a file has few of them however much one task writes."""
    text = "some words that go on " * 25_000
    docs = spark.range(40, numPartitions=1).selectExpr("id AS doc_id", f"repeat('{text[:22]}', {len(text) // 22}) AS text")
    before = common.n_stored()
    files = decontaminate.index(docs).inputFiles()
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    common.release(spark, before)
    assert sum(g.num_rows for g in groups) >= 40 * len(text) // textnum.SLICE_BYTES
    assert max(g.num_rows for g in groups) <= 4
