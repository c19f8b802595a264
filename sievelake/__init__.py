"""sievelake: data quality and analytics as plain functions from DataFrame to DataFrame."""
