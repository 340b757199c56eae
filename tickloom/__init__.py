"""A PySpark engine for time-ordered market data."""
