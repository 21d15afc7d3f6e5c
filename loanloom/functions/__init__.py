"""Column helpers and scalar statistics."""
