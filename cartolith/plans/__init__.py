"""The query catalogue: named plans over the driver's tables."""
