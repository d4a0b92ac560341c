"""Document structuring, spaced-repetition and catalogue analytics as Spark DataFrame operators."""
