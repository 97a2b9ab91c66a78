"""Query plans over the given tables, one function per registered query, with their SQL."""
