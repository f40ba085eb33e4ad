"""Sky-catalog clustering analytics as plain DataFrame jobs."""
