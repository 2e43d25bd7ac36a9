"""Per-account features, one pass and one grouping per source table."""
