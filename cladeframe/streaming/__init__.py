"""Reads that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.names import fastq_base_name
from cladeframe.operators import assignments as asg
from cladeframe.operators import classify


def filter_stream(reads: DataFrame, assignments: DataFrame, targets: DataFrame) -> DataFrame:
    """Decisions on a stream of reads (name and more) against fixed assignments and targets.

    Each read meets one assignment at most, so the joins keep no state and the stream needs no watermark. It runs
    on batch input alike.
    """
    found = asg.look_up(reads, fastq_base_name(F.col("name")), asg.collapse(assignments))
    marked = classify.mark_taxa(found, F.col("taxon_id"), targets)
    return marked.withColumn("decision", classify.decide_read(F.col("on_target"), F.col("is_ancestor"))).drop("on_target", "is_ancestor")
