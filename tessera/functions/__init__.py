"""Column expressions: cleaning of manifest text, ladders of thresholds, plane geometry, vectors."""
