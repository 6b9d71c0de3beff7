"""The reports, and the job that runs all of them over one pass of the facts."""
