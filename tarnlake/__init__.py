"""tarnlake: ranking, entity resolution and evidence coverage on Spark DataFrames."""
