"""A PySpark engine for live spatio-temporal condition data."""
