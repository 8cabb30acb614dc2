"""The stateless steps on a stream give the batch result."""

import os
import tempfile

from reviewlab.operators.sentiment import review_sentiment
from reviewlab.sources.fixtures import lexicons, reviews
from reviewlab.streaming import review_sums, scored_words
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark):
    r = reviews(spark, SF_SMALL).select("v1", "review_text")
    lx = lexicons(spark, reviews_df=reviews(spark, SF_SMALL))
    src = tempfile.mkdtemp(prefix="reviewlab-stream-src-")
    r.write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(r.schema).parquet(os.path.join(src, "in"))
    sums = review_sums(scored_words(stream, lx.stop, lx.bing, lx.afinn))
    ckpt = tempfile.mkdtemp(prefix="reviewlab-stream-ckpt-")
    q = (sums.writeStream.format("memory").queryName("review_sums_stream")
         .outputMode("complete").option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {tuple(x) for x in spark.sql("select v1, sum_sentb, sum_senta from review_sums_stream").collect()}
    want = {tuple(x) for x in review_sentiment(r, lx.stop, lx.bing, lx.afinn, keys=["v1"])
            .select("v1", "sum_sentb", "sum_senta").collect()}
    assert got == want and len(got) > 0
