"""Writers: CSV, partitioned segment tables, training text."""
