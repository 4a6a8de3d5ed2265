"""Document privacy analytics on Spark: find, resolve, pseudonymise and rewrite personal data."""
