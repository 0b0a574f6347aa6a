"""shelfmark: product-record resolution as Spark DataFrame operators."""
