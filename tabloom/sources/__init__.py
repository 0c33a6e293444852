"""Reading, writing and ingest shaping."""
