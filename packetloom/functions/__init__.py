"""Column-to-Column helpers used inside the DataFrame jobs."""
