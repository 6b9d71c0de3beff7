"""Building blocks: log parsing, channel aggregates, presence, shares and ranks."""
