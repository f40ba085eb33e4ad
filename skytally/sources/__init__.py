"""Reading, writing and describing catalogs and runs."""
