"""Basket-item analytics on Spark: parse, load, prune, curate, sample, cluster."""
