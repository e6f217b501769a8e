"""caselore: ticket-history analytics as Spark DataFrame jobs."""
