"""Spending analytics and corpus preparation on PySpark."""
