"""streaming of the prose-quality engine."""
