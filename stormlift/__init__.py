"""Storm-end analytics on Spark: strikes in, alert-lifting decisions and their worth out."""
