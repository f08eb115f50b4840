"""Part of placeloom."""
