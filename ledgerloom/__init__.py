"""Invoice-ledger analytics and corpus preparation as Spark DataFrame jobs."""
