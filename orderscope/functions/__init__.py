"""Column-expression helpers (all JVM-side except the distribution tails)."""
