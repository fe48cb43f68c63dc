"""Episode analytics on Spark: DataFrame-to-DataFrame operators for trajectories and the text that goes with them."""
