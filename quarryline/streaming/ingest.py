"""Files arriving in a folder, indexed batch by batch into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryline.functions import paths
from quarryline.operators.chunk import chunk
from quarryline.plans.store import Store, upsert


def ingest(arrivals: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """arrivals: a stream of (path, text) and, if there is one, ``arrived`` (any ordered type); a batch is one snapshot
    with new files and chunks in place of old ones.

    Of a path's rows in one batch the last to arrive counts, of equal ones that of the greater hash; so a batch that is
    repeated after a failure writes the same rows.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        arrived = F.col("arrived") if "arrived" in batch.columns else F.lit(0)
        last = F.max(F.struct(arrived.alias("arrived"), F.sha2("text", 256).alias("hash"), "text"))
        new = batch.filter(paths.language(F.col("path")) != "").groupBy("path").agg(last.alias("x")).select("path", "x.text")
        files = new.select("path", paths.language(F.col("path")).alias("language"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"))
        parts = chunk(new.withColumn("language", paths.language(F.col("path"))), ["path"])
        old_files, old_chunks = store.read("files"), store.read("chunks")
        if old_files is not None:
            parts_old = old_chunks.join(files.select("path"), "path", "left_anti")
            files, parts = upsert(old_files, files, ["path"]), parts_old.unionByName(parts)
        store.commit({"files": files, "chunks": parts})

    return arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
