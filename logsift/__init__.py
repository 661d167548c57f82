"""logsift: evidence-grounded triage of system logs as Spark DataFrame operators."""
