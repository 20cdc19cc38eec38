"""Column-level functions: every one is a pure expression that stays inside whole-stage codegen."""
