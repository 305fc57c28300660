"""Column-level building blocks: Column in, Column out."""
