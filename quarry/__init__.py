"""An analytics engine on PySpark for lead prospecting and outreach data."""
