"""Source jobs: one set of column expressions per raw format."""
