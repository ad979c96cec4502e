"""pairloom: all-pairs comparison and dependence analysis on Spark DataFrames."""
