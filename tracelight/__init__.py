"""A PySpark engine for attack provenance over system-event graphs."""
