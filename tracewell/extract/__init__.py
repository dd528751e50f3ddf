"""From source text to fact rows: one parse of each file, in Arrow batches."""
