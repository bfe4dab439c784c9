"""Part of maskwright."""
