"""Point-in-time competition analytics as Spark plans."""
