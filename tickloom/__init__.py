"""tickloom: tick, trade-list and record-cleaning analytics as Spark plans."""
