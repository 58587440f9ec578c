"""Registered queries over the driver's tables and the SQL that each must agree with."""
