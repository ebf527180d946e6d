"""Queries over the driver's tables, by family; each is a callable (spark, sf_dir) and, where SQL can say it, SQL."""
