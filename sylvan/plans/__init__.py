"""Query catalogue and its oracle SQL."""
