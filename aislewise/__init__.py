"""Web-versus-store retail analytics on Spark DataFrames."""
