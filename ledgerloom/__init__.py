"""ledgerloom: a Spark-first engine for usage-ledger analytics and corpus preparation."""
