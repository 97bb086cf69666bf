"""Inbox-to-ledger reconciliation as Spark DataFrame operators."""
