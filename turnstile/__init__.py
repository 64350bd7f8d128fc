"""Set-oriented PySpark jobs for bookings, payments, memberships and contacts."""
