"""Versioned tables, exports, and scratch space."""
