"""Trade ledger, clearing and reconciliation jobs for Spark."""
