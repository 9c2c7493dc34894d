"""Audio layouts and levels, as expressions over arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.catalog import SAMPLE_BYTES


def bytes_per_sample(sample_format: Column) -> Column:
    """1, 2, 4, 4 or 8; 0 for an unknown format."""
    out = F.when(F.lit(False), F.lit(0))
    for name, n in SAMPLE_BYTES.items():
        out = out.when(sample_format == name, F.lit(n))
    return out.otherwise(F.lit(0))


def same_format(a: Column, b: Column) -> Column:
    """Equality of sample format, rate, channels and planarity; the bits in use don't count."""
    out = F.lit(True)
    for name in ("sample_format", "sample_rate", "channels", "planar"):
        out = out & a[name].eqNullSafe(b[name])
    return out


def buffer_bytes(samples: Column, channels: Column, sample_format: Column) -> Column:
    return samples.cast("long") * channels.cast("long") * bytes_per_sample(sample_format)


def deinterleave(samples: Column, channels: int) -> Column:
    """Array of one array of samples for each channel."""
    def one(c: int) -> Column:
        return F.filter(samples, lambda x, i: i % channels == c)

    return F.array(*map(one, range(channels)))


def interleave(planes: Column) -> Column:
    """One array of samples, channel by channel; planes of other lengths are filled with null."""
    n = F.array_max(F.transform(planes, F.size))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(planes, lambda p: F.get(p, i))))


def normalise_bits(sample: Column, bits: Column) -> Column:
    """A 32-bit sample of fewer significant bits moved to the top; 0, 8 and 32 bits stay."""
    moved = F.call_function("shiftleft", sample.cast("int"), (F.lit(32) - bits).cast("int"))
    return F.when(bits.isin(0, 8, 32), sample.cast("int")).otherwise(moved)


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, F.abs)).cast("double")


def mean(samples: Column) -> Column:
    return _sum(samples, lambda x: x) / F.size(samples)


def rms(samples: Column) -> Column:
    return F.sqrt(_sum(samples, lambda x: x * x) / F.size(samples))


def _sum(samples: Column, f) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda total, x: total + f(x.cast("double")))


def gain(g: Column) -> Column:
    """A volume held to 0 to 1.5."""
    return F.least(F.greatest(g, F.lit(0.0)), F.lit(1.5))


def opus_chunks(nb_samples: Column, rate: Column) -> Column:
    """(first sample, samples) of each 20 ms chunk of a frame; the last may be short."""
    size = F.floor(rate / 50).cast("long")
    starts = F.when(nb_samples > 0, F.sequence(F.lit(0).cast("long"), nb_samples.cast("long") - 1, size)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(size, nb_samples - s).alias("samples")))
