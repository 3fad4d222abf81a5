"""Plans of the fact engine."""
