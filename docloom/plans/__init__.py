"""Part of docloom: plans."""
