"""Part of the rulewright analytics engine."""
