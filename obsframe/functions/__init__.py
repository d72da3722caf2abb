"""Column expressions: codes, statistics, calendar and special functions."""
