"""Column functions: each takes and returns `Column`s and runs inside whole-stage code generation."""
