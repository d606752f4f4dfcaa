"""sources of the prose-quality engine."""
