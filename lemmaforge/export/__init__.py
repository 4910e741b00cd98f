"""Export."""
