"""Folio links of new pages as a stream of files.

Each batch of pages is matched with the documents' ranges and written to a folder
of its own number, so a batch that is run again replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.provenance import as_links
from ..operators.sequences import folio_links

FOLIO_PAGE = "inventory_id string, page_id string, page_or_folio_number string"


def link_new_pages(spark: SparkSession, folder: str, documents: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A query that links the pages of each new Parquet file in `folder`; with `once`, it ends when all there is has been read."""
    pages = spark.readStream.schema(FOLIO_PAGE).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        as_links(folio_links(batch, documents), "FOLIO_RANGE", "FOLIO_RANGE").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
