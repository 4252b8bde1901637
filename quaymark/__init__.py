"""Point-in-time analytics over price bars, cross-market series and news, as Spark jobs."""
