"""termloom: DataFrame jobs for concept recognition and association over article corpora."""
