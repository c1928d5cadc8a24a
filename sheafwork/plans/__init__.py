"""Ready-made plans: the corpus interface, and the queries that the driver compares with SQL."""
