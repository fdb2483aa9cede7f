"""Part of docloom: operators."""
