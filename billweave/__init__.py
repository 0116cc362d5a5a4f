"""billweave: invoice-document analytics as Spark jobs."""
