"""WGS84 coordinates as Column expressions; angles in degrees, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid's semi-major axis and flattening.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
ECCENTRICITY_SQ = FLATTENING * (2.0 - FLATTENING)


def lla_to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    p, m = F.radians(lat), F.radians(lon)
    n = F.lit(SEMI_MAJOR) / F.sqrt(1.0 - ECCENTRICITY_SQ * F.sin(p) * F.sin(p))
    return (n + alt) * F.cos(p) * F.cos(m), (n + alt) * F.cos(p) * F.sin(m), (n * (1.0 - ECCENTRICITY_SQ) + alt) * F.sin(p)


def ecef_to_enu(x: Column, y: Column, z: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a point in the frame at (lat0, lon0, alt0)."""
    x0, y0, z0 = lla_to_ecef(lat0, lon0, alt0)
    dx, dy, dz = x - x0, y - y0, z - z0
    p, m = F.radians(lat0), F.radians(lon0)
    east = -F.sin(m) * dx + F.cos(m) * dy
    north = -F.sin(p) * F.cos(m) * dx - F.sin(p) * F.sin(m) * dy + F.cos(p) * dz
    up = F.cos(p) * F.cos(m) * dx + F.cos(p) * F.sin(m) * dy + F.sin(p) * dz
    return east, north, up


def ecef_to_lla(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude by Bowring's closed form, exact to far below a millimetre near the ground; on the axis 90 degrees north or
    south.  The height is the part along the ellipsoid's normal, so it's as good near the poles as elsewhere."""
    r, b = F.sqrt(x * x + y * y), SEMI_MAJOR * (1.0 - FLATTENING)
    theta = F.atan2(z * SEMI_MAJOR, r * b)
    lat = F.atan2(z + ECCENTRICITY_SQ / (1.0 - ECCENTRICITY_SQ) * b * F.pow(F.sin(theta), 3), r - ECCENTRICITY_SQ * SEMI_MAJOR * F.pow(F.cos(theta), 3))
    n = F.lit(SEMI_MAJOR) / F.sqrt(1.0 - ECCENTRICITY_SQ * F.sin(lat) * F.sin(lat))
    height = r * F.cos(lat) + z * F.sin(lat) - n * (1.0 - ECCENTRICITY_SQ * F.sin(lat) * F.sin(lat))
    axis = r < 1e-9
    return F.when(axis, F.when(z >= 0, 90.0).otherwise(-90.0)).otherwise(F.degrees(lat)), F.degrees(F.atan2(y, x)), F.when(axis, F.abs(z) - b).otherwise(height)


def enu_to_ecef(east: Column, north: Column, up: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """The point at (east, north, up) of the frame at (lat0, lon0, alt0)."""
    x0, y0, z0 = lla_to_ecef(lat0, lon0, alt0)
    p, m = F.radians(lat0), F.radians(lon0)
    return (
        x0 - F.sin(m) * east - F.sin(p) * F.cos(m) * north + F.cos(p) * F.cos(m) * up,
        y0 + F.cos(m) * east - F.sin(p) * F.sin(m) * north + F.cos(p) * F.sin(m) * up,
        z0 + F.cos(p) * north + F.sin(p) * up,
    )


def enu_to_lla(east: Column, north: Column, up: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    return ecef_to_lla(*enu_to_ecef(east, north, up, lat0, lon0, alt0))
