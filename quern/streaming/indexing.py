"""Keeps an index fresh from a stream of sources (file_path, text): an extension beyond single refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index


def index_stream(sources: DataFrame, index: Index, checkpoint: str, **trigger) -> StreamingQuery:
    """One refresh for each batch. A batch that runs again finds its hashes in place and changes nothing.

    Of several versions of a file in one batch none is indexed, as their order is open (see `Index.refresh`).
    """

    def refresh(batch: DataFrame, _: int) -> None:
        index.refresh(batch)

    writer = sources.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
