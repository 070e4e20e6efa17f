"""Evidence-first analytics on Spark: DataFrame operators whose every output value is traceable."""
