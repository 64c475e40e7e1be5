"""The stateless cleansing on a file stream gives the same words as the batch form."""

import tempfile

from corpuslab.operators import cleanse
from corpuslab.functions import text as tx
from corpuslab.sources.tables import articles
from corpuslab.streaming.cleanse_stream import read_article_stream, stream_words

SF = "/root/testdata/sf0.001"


def test_stream_words_equal_batch(spark):
    src = tempfile.mkdtemp(prefix="corpuslab-stream-")
    a = articles(spark, SF).limit(50)
    a.write.mode("overwrite").parquet(src)
    a = spark.read.parquet(src)  # a limit without an order may pick other rows each time it runs
    batch = a.select("doc_id", tx.dateline_strip("text").alias("text"))
    expected = sorted(tuple(r) for r in cleanse.word_table(batch, "doc_id").select("doc_id", "order", "word").collect())
    q = (stream_words(read_article_stream(spark, src)).select("doc_id", "order", "word")
         .writeStream.format("memory").queryName("stream_words_test").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("select * from stream_words_test").collect())
    assert got == expected
