"""Column expressions used inside table jobs (never stand-alone UDFs)."""
