"""E-commerce analytics jobs for PySpark: explore, validate, KPIs, segments, journeys, products, metrics."""
