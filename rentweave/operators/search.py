"""Search criteria, region and URL filters over landed rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentweave.functions.geo import within_radius
from rentweave.functions.numbers import leading_number

INF = float("inf")


@dataclass(frozen=True)
class ClientCriteria:
    """Criteria a portal cannot apply itself. Null rules differ by field and are part of the contract."""

    cities: Sequence[str] = ()
    zipcodes: Sequence[str] = ()
    price_min: float | None = None
    price_max: float | None = None
    rooms_min: float | None = None
    rooms_max: float | None = None
    surface_min: float | None = None
    offer_type: str = "RENT"
    category: str = "APARTMENT"
    near: tuple[float, float, float] | None = None  # lat, lon, radius in metres


def client_filters(
    df: DataFrame,
    c: ClientCriteria,
    city: str = "city",
    zipcode: str = "zipcode",
    price: str = "price_display",
    rooms: str = "number_of_rooms",
    surface: str = "surface_living",
    offer_type: str = "offer_type",
    category: str = "object_category",
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Null city, offer type and category pass; null zip and coordinates fail; a null price is infinite; null
    rooms and surface are 0; a rooms text that is no number passes both bounds."""
    blank_ok = lambda col, keep: F.col(col).isNull() | (F.col(col) == "") | keep
    tests: list[Column] = []
    if c.cities:
        tests.append(blank_ok(city, F.col(city).isin(list(c.cities))))
    if c.zipcodes:
        tests.append(F.coalesce(F.col(zipcode).cast("string").isin(list(c.zipcodes)), F.lit(False)))
    cost = F.coalesce(F.col(price).cast("double"), F.lit(INF))
    if c.price_max is not None:
        tests.append(cost <= F.lit(float(c.price_max)))
    if c.price_min is not None:
        tests.append(cost >= F.lit(float(c.price_min)))
    count = F.when(F.col(rooms).isNull(), F.lit(0.0)).otherwise(leading_number(F.col(rooms).cast("string")))
    if c.rooms_min is not None:
        tests.append(F.coalesce(count >= F.lit(float(c.rooms_min)), F.lit(True)))
    if c.rooms_max is not None:
        tests.append(F.coalesce(count <= F.lit(float(c.rooms_max)), F.lit(True)))
    if c.surface_min is not None:
        tests.append(F.coalesce(F.col(surface).cast("double"), F.lit(0.0)) >= F.lit(float(c.surface_min)))
    if c.offer_type:
        tests.append(blank_ok(offer_type, F.col(offer_type) == c.offer_type))
    if c.category:
        tests.append(blank_ok(category, F.col(category) == c.category))
    if c.near is not None:
        tests.append(within_radius(F.col(lat), F.col(lon), *c.near))
    for test in tests:
        df = df.filter(test)
    return df


def zip_allowlist(df: DataFrame, zipcodes: Sequence[str], postal_code: str = "location.postal_code") -> DataFrame:
    """Empty list is off; a null postal code is dropped when on."""
    return df.filter(F.col(postal_code).isin(list(zipcodes))) if zipcodes else df


@dataclass(frozen=True)
class Region:
    postal_codes: Sequence[str] = ()
    cities: Sequence[str] = ()
    cantons: Sequence[str] = ()

    def __bool__(self) -> bool:
        return bool(self.postal_codes or self.cities or self.cantons)


def region_filter(df: DataFrame, region: Region) -> DataFrame:
    """Keep rows that match any configured list; rows without a location are dropped when any list is set."""
    if not region:
        return df
    hit = F.lit(False)
    if region.postal_codes:
        hit = hit | F.coalesce(F.col("location.postal_code").isin(list(region.postal_codes)), F.lit(False))
    if region.cities:
        wanted = [c.lower() for c in region.cities]
        hit = hit | F.coalesce(F.lower("location.city").isin(wanted), F.lit(False))
    if region.cantons:
        wanted = [c.upper() for c in region.cantons]
        hit = hit | F.coalesce(F.upper("location.region").isin(wanted), F.lit(False))
    return df.filter(hit)


@dataclass(frozen=True)
class SearchCriteria:
    """Portal-side search, applied to landed canonical rows."""

    zipcodes: Sequence[str] = ()
    price_min: float | None = None
    price_max: float | None = None
    rooms_min: float | None = None
    rooms_max: float | None = None
    surface_min: float | None = None
    surface_max: float | None = None
    has_balcony: bool | None = None
    has_elevator: bool | None = None
    property_types: Sequence[str] = ()
    sort_by: str = "dateCreated"
    sort_direction: str = "desc"
    page_size: int | None = None
    pages: int = 1
    first_page: int = 0
    tie_break: Sequence[str] = field(default=("url",))


# Sort names portals accept.
SORT_COLUMNS = {
    "dateCreated": "first_seen_at",
    "price": "price.total",
    "roomCount": "rooms",
    "livingSpace": "area_m2",
}


def search_criteria(df: DataFrame, c: SearchCriteria) -> DataFrame:
    tests = []
    if c.zipcodes:
        tests.append(F.col("location.postal_code").isin([str(z) for z in c.zipcodes]))
    for path, low, high in (
        ("price.total", c.price_min, c.price_max),
        ("rooms", c.rooms_min, c.rooms_max),
        ("area_m2", c.surface_min, c.surface_max),
    ):
        if low is not None:
            tests.append(F.col(path) >= F.lit(float(low)))
        if high is not None:
            tests.append(F.col(path) <= F.lit(float(high)))
    for name, wanted in (("has_balcony", c.has_balcony), ("has_elevator", c.has_elevator)):
        if wanted is not None:
            tests.append(F.try_element_at(F.col("features"), F.lit(name)) == str(wanted).lower())
    if c.property_types:
        tests.append(F.try_element_at(F.col("extra"), F.lit("property_type")).isin(list(c.property_types)))
    for test in tests:
        df = df.filter(test)
    if c.page_size is None:
        return df
    by = F.col(SORT_COLUMNS[c.sort_by])
    by = by.desc_nulls_last() if c.sort_direction == "desc" else by.asc_nulls_last()
    return page_slice(df.orderBy(by, *c.tie_break), c.page_size, c.pages, c.first_page)


def page_slice(ordered: DataFrame, page_size: int, pages: int = 1, first_page: int = 0) -> DataFrame:
    """The given pages of an ordered result."""
    skip = page_size * first_page
    return (ordered.offset(skip) if skip else ordered).limit(page_size * pages)


def url_include(df: DataFrame, parts: Sequence[str], url: str = "loc") -> DataFrame:
    """Keep URLs that contain any of the parts; no parts keeps all."""
    if not parts:
        return df
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.col(url).contains(part)
    return df.filter(hit)


def detail_url_pattern(df: DataFrame, pattern: str | None, url: str = "loc") -> DataFrame:
    return df.filter(F.col(url).rlike(pattern)) if pattern else df
