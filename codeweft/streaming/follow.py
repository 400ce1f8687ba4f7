"""Follow source trees: the files of every arriving batch are brought into the store."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from codeweft import build
from codeweft.sources.config import Workspace
from codeweft.sources.store import Store


def follow(spark: SparkSession, store: Store, workspace: Workspace, root: str, watched: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Watch the folder ``watched`` for new and rewritten files and bring each batch of them into the store.

    A batch looks at its own files only, hashes them and extracts those that changed; the
    first one of an empty store builds all projects. Files that vanish don't arrive: the next
    build finds them. A batch that is run again finds nothing changed, so a restart
    from the checkpoint neither loses nor repeats rows.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrivals = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(watched)
    arrivals = arrivals.select("path")

    def update(batch, number: int) -> None:
        if not store.version():
            build.run(spark, store, workspace, root)
        elif not batch.isEmpty():
            build.run(spark, store, workspace, root, trust_times=False, only=batch)

    writer = arrivals.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
