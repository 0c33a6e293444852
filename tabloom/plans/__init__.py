"""Multi-step jobs: the feature engine, training and scoring."""
