"""functions of the prose-quality engine."""
