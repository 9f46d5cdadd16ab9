"""The live index against an index built at once."""

import pytest

from quillsift.sources import index, shared
from quillsift.streaming import live

SCHEMA = "doc_id long, text string"
BATCHES = (
    [(1, "the sun is red. the moon is white."), (2, "one two three four."), (3, "a b c d."), (5, None), (None, "no id here at all.")],
    [(2, "five six seven eight. nine ten eleven."), (4, "new one comes here."), (4, "a smaller text of four.")],
    [(3, None), (1, "the sun is red."), (6, " ")],
)
AFTER = [(1, "the sun is red."), (2, BATCHES[1][0][1]), (4, "new one comes here.")]


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def stream_in(spark, path, batch):
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/given")
    live.ingest(spark.readStream.schema(SCHEMA).parquet(f"{path}/given"), f"{path}/index", f"{path}/checkpoint").awaitTermination()


@pytest.mark.parametrize("compactions", [(), (0,), (1,), (0, 1, 2)])
def test_equals_an_index_built_at_once(spark, tmp_path, compactions):
    path = str(tmp_path)
    for i, batch in enumerate(BATCHES):
        stream_in(spark, path, batch)
        if i in compactions:
            live.compact(spark, f"{path}/index")
    at_once = index.build(spark.createDataFrame(AFTER, SCHEMA), f"{path}/at_once")
    now = live.current(spark, f"{path}/index")
    assert rows(now["sentences"].select("doc_id", "sent_id", "sentence", "terms")) == rows(at_once["sentences"])
    assert rows(now["documents"]) == rows(at_once["documents"])
    assert rows(live.postings(spark, f"{path}/index").select("term", "doc_id", "sent_ids")) == rows(at_once["postings"].select("term", "doc_id", "sent_ids"))
    assert rows(live.postings(spark, f"{path}/index", ["sun"]).select("doc_id")) == ["(1,)"]
    whole = live.compact(spark, f"{path}/index")
    assert rows(whole["postings"].select("term", "doc_id", "sent_ids")) == rows(at_once["postings"].select("term", "doc_id", "sent_ids"))
    assert shared.children(spark, f"{path}/index") == ["base=2"]


def test_a_stopped_compaction_and_a_batch_that_runs_again_are_not_seen(spark, tmp_path):
    path = str(tmp_path)
    stream_in(spark, path, BATCHES[0])
    before = rows(live.current(spark, f"{path}/index")["sentences"])
    half = spark.createDataFrame([(9,)], "doc_id long")
    half.write.parquet(f"{path}/index/base=0/documents")  # no postings yet
    half.write.parquet(f"{path}/index/run=7/sentences")  # no changes yet
    assert rows(live.current(spark, f"{path}/index")["sentences"]) == before
    assert rows(live.compact(spark, f"{path}/index")["sentences"].select("doc_id", "sent_id", "sentence", "terms")) == before
    assert rows(live.compact(spark, f"{path}/index")["documents"]) == ["(1,)", "(2,)", "(3,)"]
    with pytest.raises(FileNotFoundError):
        live.current(spark, f"{path}/none")
    with pytest.raises(FileNotFoundError):
        live.postings(spark, f"{path}/none")
