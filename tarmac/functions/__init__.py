"""Column-level building blocks: names, dates, geometry, predicates."""
