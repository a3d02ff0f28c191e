"""DataFrame operators on reads, signals, scores and regions."""
