"""operators of the prose-quality engine."""
