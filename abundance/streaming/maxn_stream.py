"""MaxN over count exports that keep arriving (Structured Streaming).

The reference has no streaming feature; this is the batch MaxN workflow
(C2) pointed at a folder that receives new count files, for campaigns
whose annotations land deployment by deployment. The stateless steps
(success filter, relabels, taxon label) run per micro-batch; the MaxN
aggregate keeps one state row per deployment x taxon; ``update`` output
writes changed maxima to a Parquet folder per batch. A replayed batch (after
an executor or driver loss) overwrites its own folder, and ``read_maxn``
takes the newest row per key. Checkpoints go under the
shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from abundance.plans.pipelines import complete_counts
from abundance.session import checkpoint_dir


def start_maxn_stream(spark: SparkSession, source_dir: str, schema: str, sink_dir: str,
                      rules: Sequence[tuple] = (), keys: Sequence[str] = ("sample",),
                      taxon_parts: Sequence[str] = ("family", "genus", "species"),
                      name: str = "maxn", available_now: bool = True,
                      checkpoint: str | None = None) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops
    (schedule it), otherwise it runs continuously."""
    src = spark.readStream.schema(schema).option("header", True).csv(source_dir)
    maxn = complete_counts(src, rules, keys=list(keys), taxon_parts=list(taxon_parts))
    ckpt = checkpoint or posixpath.join(checkpoint_dir(spark), f"stream-{name}")

    def sink(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch: a batch that is replayed overwrites its own folder.
        batch.write.mode("overwrite").parquet(posixpath.join(sink_dir, f"batch_id={batch_id}"))

    w = maxn.writeStream.outputMode("update").option("checkpointLocation", ckpt).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_maxn(spark: SparkSession, sink_dir: str, keys: Sequence[str] = ("sample",),
              taxon_parts: Sequence[str] = ("family", "genus", "species")) -> DataFrame:
    """Current MaxN table: the newest update of each key. Updates replace
    earlier ones, so a MaxN that has become missing stays missing, as in the
    batch workflow."""
    k = [*keys, *taxon_parts, "scientific"]
    return spark.read.parquet(sink_dir).groupBy(*k).agg(F.max_by("count", "batch_id").alias("count"))
