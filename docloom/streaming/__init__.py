"""Part of docloom: streaming."""
