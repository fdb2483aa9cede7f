"""Part of docloom: functions."""
