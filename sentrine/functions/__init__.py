"""Part of sentrine."""
