"""flowaudit: Spark jobs that prepare network-flow tables and audit model explanations."""
