"""Part of lintel."""
