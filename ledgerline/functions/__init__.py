"""Column expressions; nothing in here starts a job."""
