"""Column functions: text, scoring, rules and geometry."""
