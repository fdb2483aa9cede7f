"""Part of docloom: sources."""
