"""Part of doctrail."""
