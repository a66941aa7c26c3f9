"""Search for the subset of a multivariate series' columns that best predicts a target, on Spark."""
