"""sluice: analytics operators as composable PySpark DataFrame functions."""
