"""Column-level building blocks (no shuffles, all inside whole-stage codegen)."""
