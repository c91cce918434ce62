"""tracespark: Spark jobs for imaging traces, behaviour logs and text corpora."""
