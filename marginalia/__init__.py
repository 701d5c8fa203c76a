"""marginalia: documentation-corpus analytics expressed as Spark DataFrames."""
