"""Files: GPS series, pair lists, point clouds."""
