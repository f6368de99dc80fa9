"""Spark operators for certificate-transparency logs."""
