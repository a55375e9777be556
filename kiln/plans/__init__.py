"""Composed reports and preparation chains; ``catalog`` registers queries."""
