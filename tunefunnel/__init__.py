"""tunefunnel: two-stage playlist recommendation as Spark jobs (see README)."""
