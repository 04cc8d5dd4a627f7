"""Set-oriented analytics for appointment-booking marketplaces on Spark."""
