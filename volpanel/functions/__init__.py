"""Column-level building blocks: three-valued logic, guarded maths, pricing, dates."""
