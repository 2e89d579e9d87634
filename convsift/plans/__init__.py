"""User-facing compositions of the operators (the unified search entry)."""
