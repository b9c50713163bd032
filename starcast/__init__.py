"""Rating prediction on Spark: collaborative filtering, linear, boosted-tree and stacked models."""
