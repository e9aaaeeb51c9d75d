"""Op-log streams into collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import Collection


def upsert(stream: DataFrame, collection: Collection, checkpoint: str, name: str = "upsert", compact_every: int = 0, factor: int = 2, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that adds each micro-batch of op-log rows as a container, once even if a batch is run again.

    Batches are only appended: the newest entry of each key is worked out by reads and by compaction.  Every
    ``compact_every`` batches (0: never) the tiers that have enough containers of about a size are merged, so a batch costs
    what it holds, an entry is rewritten once for each power of ``factor`` or so, and no state is kept between batches."""

    def add(batch: DataFrame, number: int) -> None:
        collection.append(batch, (name, number))
        if compact_every and (number + 1) % compact_every == 0:
            collection.compact_tiers(factor)

    writer = stream.writeStream.queryName(name).foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
