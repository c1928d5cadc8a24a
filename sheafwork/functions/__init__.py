"""PDF syntax in plain Python (workers import it alone), and in sql.py the same as SQL functions."""
