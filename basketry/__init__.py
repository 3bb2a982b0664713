"""Retail sales lakehouse on Spark: feeds -> canonical rows -> star -> reports."""
