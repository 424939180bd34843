"""The reports. Each takes ``(tables, from_date, to_date, **filters)`` and returns a DataFrame."""
