"""DataFrame to DataFrame operators; columns are given by name."""
