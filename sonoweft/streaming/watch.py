"""An extension: utterance tables that arrive as files are aligned as they come.

The batch library has no stream; this wraps the same operators in Structured
Streaming, so a restarted stream goes on where its checkpoint says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import speech
from ..plans.aligner import Model


def aligned_stream(spark: SparkSession, source: str, schema: str, model: Model, sink: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Aligns Parquet files of utterances (utt, words, feats, seconds) in ``source`` and appends intervals to ``sink``.

    Each micro-batch is written under its own number, so a batch that is
    repeated after a failure replaces itself.
    """

    def batch(utts: DataFrame, number: int) -> None:
        utts = utts.persist()
        speech.align(utts, model).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        utts.unpersist()

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
