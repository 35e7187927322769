"""Query registry: named plans over the driver tables and their SQL oracles."""
