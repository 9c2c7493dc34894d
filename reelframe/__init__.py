"""Media tables (sources, tracks, packets, frames) as Spark DataFrames."""
