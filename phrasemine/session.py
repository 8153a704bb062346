"""Session settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Number of parts that the given tables are dealt into after their scan; unset: as scanned.
INPUT_PARTITIONS = "spark.phrasemine.inputPartitions"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins go from sort-merge to hash only once the built partitions are seen to be small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # One open file per type while counts are written, in place of a sort by type. A task then
    # buffers a row group for each type it meets, 28 at most; give executors some 1 GB a core.
    "spark.sql.maxConcurrentOutputFileWriters": "32",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the recommended settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
