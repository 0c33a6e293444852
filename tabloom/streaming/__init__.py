"""The same features, scores and profiles on streams."""
