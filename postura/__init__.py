"""postura: network posture analytics and corpus preparation on Spark DataFrames."""
