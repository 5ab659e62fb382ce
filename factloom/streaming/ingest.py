"""An extension: JSONL that arrives as files is imported batch by batch, each once, whatever dies in between.

Each batch loads the last commit, imports and commits: tables, ledger and provenance in one rename (sources/versions.py). The ledger knows a batch
by the stream and its number, so a batch that Spark repeats after a crash is replayed if its commit was made, and imported if not.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.jsonl import import_jsonl
from ..sources.versions import VersionStore


def import_batch(store: VersionStore, lines, number: int, entity_type: str, key: dict[str, str], stream: str) -> dict:
    """One batch of a stream: the import's result, replayed if the store has it."""
    memory = store.load()
    result = import_jsonl(memory, entity_type, lines, key, content_hash=f"{stream}#{number}", source={"kind": "stream", "locator": stream})
    if not result["replayed"]:
        store.commit(memory)
    return result


def stream_jsonl(spark: SparkSession, root: str, path: str, entity_type: str, key: dict[str, str], checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Imports each new file under path into the store at root; stops when all that is there has been read. The checkpoint names the stream."""
    store = VersionStore(spark, root)

    def batch(df, number):
        if not df.isEmpty():
            import_batch(store, df, number, entity_type, key, checkpoint)

    source = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
