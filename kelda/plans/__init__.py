"""Query catalogue: each query is a function of (spark, directory) with an optional SQL twin."""
