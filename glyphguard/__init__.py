"""Name-spoof matching and pair-similarity evaluation on Spark."""
