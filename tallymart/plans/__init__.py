"""Report queries over the mart."""
