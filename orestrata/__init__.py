"""A lakehouse quality and analytics engine on Spark alone: raw files to typed tables to business questions."""
