"""Angles, distances and radii on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
EARTH_KM = 6_371.0
KM_A_DEGREE = 111.0
TILE_STEP = 0.008
ROAD_SPACING_M = 60.0


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int | float) else x


def central_angle(lat1, lon1, lat2, lon2) -> Column:  # noqa: ANN001
    """Haversine angle in radians; the clamp keeps antipodes off NaN."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlon = F.radians(_c(lat2) - _c(lat1)), F.radians(_c(lon2) - _c(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:  # noqa: ANN001
    return EARTH_M * central_angle(lat1, lon1, lat2, lon2)


def bearing(lat1, lon1, lat2, lon2) -> Column:  # noqa: ANN001
    """Initial bearing in [0, 360); 0 for a segment of no length."""
    a, b, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    x = F.sin(d) * F.cos(b)
    y = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))


def undirected(angle: Column) -> Column:
    return F.pmod(angle, F.lit(180.0))


def signed_diff(a, b) -> Column:  # noqa: ANN001
    """a - b in [-180, 180)."""
    return F.pmod(_c(a) - _c(b) + 180, F.lit(360.0)) - 180


def lat_span(radius_km) -> Column:  # noqa: ANN001
    return _c(radius_km) / KM_A_DEGREE


def lon_span(radius_km, lat) -> Column:  # noqa: ANN001
    return _c(radius_km) / (KM_A_DEGREE * F.greatest(F.cos(F.radians(_c(lat))), F.lit(0.1)))


def in_bbox(lat, lon, centre_lat, centre_lon, radius_km) -> Column:  # noqa: ANN001
    """A square around the centre: plain range predicates, so literals reach the scan."""
    dy, dx = lat_span(radius_km), lon_span(radius_km, centre_lat)
    return _c(lat).between(_c(centre_lat) - dy, _c(centre_lat) + dy) & _c(lon).between(_c(centre_lon) - dx, _c(centre_lon) + dx)


def search_radius_km(lat, lat_std, lon_std, least: float = 3.0, most: float = 15.0) -> Column:  # noqa: ANN001
    """A cluster's spread, clamped; road-sampled search takes most = 8."""
    spread = F.hypot(_c(lat_std) * KM_A_DEGREE, _c(lon_std) * KM_A_DEGREE * F.greatest(F.cos(F.radians(_c(lat))), F.lit(0.1)))
    return F.least(F.greatest(spread, F.lit(least)), F.lit(most))


def spread_km(lat, lat_std, lon_std) -> Column:  # noqa: ANN001
    """The spread as shown: no floor under the cosine; null without deviations."""
    return F.hypot(_c(lat_std) * KM_A_DEGREE, _c(lon_std) * KM_A_DEGREE * F.cos(F.radians(F.coalesce(_c(lat), F.lit(0.0)))))


def refine_radius_km(spread: Column) -> Column:
    return F.coalesce(F.least(F.greatest(spread, F.lit(0.5)), F.lit(20.0)), F.lit(2.0))


def map_zoom(radius_km) -> Column:  # noqa: ANN001
    r = _c(radius_km)
    return F.when(r > 6, 10).when(r > 2, 12).otherwise(13)
