"""Column helpers and distribution tails."""
