"""plans of the prose-quality engine."""
