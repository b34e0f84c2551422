"""Full-text search: query rewriting and parsing on the driver, matching and ranking on DataFrames."""
