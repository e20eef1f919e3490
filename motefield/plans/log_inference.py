"""From a tree of raw logs to one prediction per recording, with the recordings that fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.functions.iq import iq_array
from motefield.functions.paths import device_of, label_of, recording_dir
from motefield.operators import repair, votes
from motefield.operators.packets import mean_amplitude, rejected_units
from motefield.functions.iq import iq_amplitude, lenient_int
from motefield.ranking import positions


def log_packets(lines: DataFrame) -> DataFrame:
    """Repaired packets of all logs with path metadata and packet position ``t``."""
    rows = repair.repaired_log(repair.repaired_rows(lines))
    p = F.col("path")
    ordered = positions(rows, ["path"], ["row_no"], "t")
    return ordered.select(
        "path", "t", device_of(p).alias("device"), label_of(p).alias("label"), recording_dir(p).alias("recording_id"),
        lenient_int(F.col("rssi_dbm")).alias("rssi"), iq_array(F.col("csi_data")).alias("iq"),
    )


def unit_signals(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean amplitude of the accepted units, and the rejected units with the reason."""
    rejected = rejected_units(packets, "path")
    good = packets.join(rejected, "path", "left_anti")
    signal = good.select(
        F.col("path").alias("unit_id"), "recording_id", "device", "label", "t", "rssi",
        mean_amplitude(iq_amplitude(F.col("iq"))).alias("x"),
    )
    return signal, rejected


def recording_votes(scored: DataFrame, rejected: DataFrame, lines: DataFrame, devices: list[str]) -> DataFrame:
    """One row per recording: its prediction, or why there is none.

    The last path in sorted order counts when a receiver has several logs.
    """
    last = scored.groupBy("recording_id", "device").agg(F.max_by("y_pred", "unit_id").alias("pred"))
    voted = votes.vote_of_three(last, "recording_id", devices=len(devices)).select("recording_id", "pred")
    p = F.col("path")
    seen = lines.select("path").distinct().select("path", recording_dir(p).alias("recording_id"), device_of(p).alias("device"))
    known = seen.groupBy("recording_id").agg(
        F.array_join(F.array_except(F.array(*[F.lit(d) for d in devices]), F.collect_set("device")), ",").alias("missing")
    )
    broken = rejected.select(recording_dir(p).alias("recording_id"), "reason")
    broken = broken.groupBy("recording_id").agg(F.min("reason").alias("reason"))
    joined = known.join(voted, "recording_id", "left").join(broken, "recording_id", "left")
    error = (
        F.when(F.col("pred").isNotNull(), F.lit(None))
        .when(F.col("missing") != "", F.concat(F.lit("missing receivers: "), F.col("missing")))
        .otherwise(F.coalesce(F.col("reason"), F.lit("no prediction")))
    )
    return joined.select("recording_id", "pred", error.alias("error"))
