"""A governed-statistics and corpus-preparation engine written against the PySpark DataFrame API."""
