"""Restaurant sales analytics on Spark: normalise exports, check them, serve marts."""
