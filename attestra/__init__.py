"""Forensic data-quality operators for tables of any size, written as Spark jobs."""
