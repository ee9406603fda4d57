"""Column-level building blocks: fixed patterns, text helpers, detectors, JSON columns."""
