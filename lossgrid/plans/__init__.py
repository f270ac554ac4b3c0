"""Named queries: SQL track (s*), master track (n*), chart datasets (v*)."""
