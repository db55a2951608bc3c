"""Versioned, transactional tables and their analytics on Spark."""
