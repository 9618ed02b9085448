"""Keep a feature store current while crops arrive: a file stream on the crop folder, one incremental extraction per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxelframe.plans.extraction import extract_pending
from voxelframe.plans.maps import crop_voxels

CROP_SCHEMA = "case_id bigint, label_id int, shape array<int>, image array<float>, mask array<tinyint>"
KEYS = ["case_id", "label_id"]


def extract_stream(
    spark: SparkSession, crops: str, store: str, checkpoint: str, config_hash: str, families: tuple[str, ...],
    levels: Callable[[DataFrame], DataFrame], with_shape: bool = True,
) -> StreamingQuery:
    """Process every crop file that is there, then stop. A replayed batch finds its regions stored and adds nothing.

    ``levels`` turns region voxels into discretised region voxels.
    """
    def each(batch: DataFrame, _: int) -> None:
        regions = crop_voxels(batch, KEYS).where("inside = 1")
        extract_pending(levels(regions), store, config_hash, KEYS, families, with_shape=with_shape)

    stream = spark.readStream.schema(CROP_SCHEMA).option("maxFilesPerTrigger", 1000).parquet(crops)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
