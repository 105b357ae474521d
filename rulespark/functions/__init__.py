"""Part of the decision-table engine."""
