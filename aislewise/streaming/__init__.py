"""The log parser on an unbounded source."""
