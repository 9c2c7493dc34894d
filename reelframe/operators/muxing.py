"""Checks and parameters of encoders and muxers, as relations and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.catalog import RATE_MODES


def orphans(packets: DataFrame, tracks: DataFrame, on: list[str]) -> DataFrame:
    """Packets of a stream that no track declares, with error_code 3007."""
    return packets.join(tracks.select(*on).distinct(), on, "left_anti").withColumn("error_code", F.lit(3007))


def muxable(tracks: DataFrame) -> DataFrame:
    """Audio and video tracks; others can't be added to a container."""
    return tracks.where(F.col("type").isin("audio", "video"))


def mode_index(mode: Column) -> Column:
    """Place of a rate control mode, null for an unknown one."""
    out = F.when(mode == RATE_MODES[0], F.lit(0))
    for k, name in enumerate(RATE_MODES[1:], 1):
        out = out.when(mode == name, F.lit(k))
    return out


def bitrate_updates(mode: Column) -> Column:
    """Whether a change of bit rate has an effect: only in the vbr, cbr and abr modes."""
    return mode.isin("vbr", "cbr", "abr")


def rate_control_error(mode: Column, target: Column, quality: Column, qp: Column) -> Column:
    """0, or 4004 where the parameter that the mode needs is missing or not positive."""
    ok = (
        F.when(mode.isin("crf", "icq"), quality.isNotNull())
        .when(mode == "cqp", qp.isNotNull())
        .when(mode_index(mode).isNotNull(), F.coalesce(target > 0, F.lit(False)))
        .otherwise(F.lit(False))
    )
    return F.when(ok, F.lit(0)).otherwise(F.lit(4004))
