"""Registered queries over the driver's tables: each has the SQL that gives the same rows, if SQL can."""
