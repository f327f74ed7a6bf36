"""Query registry and plan utilities."""
