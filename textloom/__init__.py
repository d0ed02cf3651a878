"""Text coverage analytics on PySpark: extraction, scoring, matching, auditing and reporting of translated and templated text."""
