"""DataFrame operators: profiles, checks, run history, similarity search."""
