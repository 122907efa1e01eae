"""Column functions: identifiers, geometry, cameras, geodesy and two-view decisions."""
