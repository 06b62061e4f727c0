"""wavemill: ordered multi-channel sample streams as Spark DataFrames."""
