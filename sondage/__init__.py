"""Text-index analytics on Spark: analysis, Boolean and phrase search, ranking, versioned keys, nearest points, substrings."""
