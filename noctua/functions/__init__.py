"""Column-level helpers (JVM-side expressions) and small per-batch helpers."""
