"""Column-level helpers (all JVM-side built-ins) and fixed code sets."""
