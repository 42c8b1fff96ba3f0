"""Document-screening analytics as DataFrame operators."""
