"""End-to-end dataflows."""
