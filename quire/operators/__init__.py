"""Set-oriented operators over library tables."""
