"""Composed flows (J1-J9) and the registered query catalogue."""
