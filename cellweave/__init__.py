"""Grid analytics on Spark: cell grids, load-balanced partitioning, spread simulation, online rebalancing."""
