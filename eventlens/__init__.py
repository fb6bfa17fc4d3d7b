"""Event and market analytics as DataFrame -> DataFrame operators on Spark."""
