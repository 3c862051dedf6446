"""Daily risk modelling and document-collection audits as plain Spark jobs."""
