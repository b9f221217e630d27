"""DataFrame-to-DataFrame operators with explicit keys and ordering."""
