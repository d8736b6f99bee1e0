"""SQL text to plans: parameters, statements that Spark lacks, and plan output."""
