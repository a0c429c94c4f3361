"""Input schemas, readers, and the input tables derived from the benchmark tables."""
