"""Topic models over count tables."""
