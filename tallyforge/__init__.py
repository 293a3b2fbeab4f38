"""Investment-ledger and bond analytics as Spark DataFrame operators."""
