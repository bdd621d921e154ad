"""Survey counts on Spark: season means, area shares, rankings and trends as DataFrame jobs."""
