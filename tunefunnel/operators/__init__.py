"""DataFrame-in, DataFrame-out operators; each runs for all requests at once."""
