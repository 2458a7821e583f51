"""Addresses of map services' tiles as column expressions; a null level, column, row or extent gives a null address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import uris
from tessella.functions.volumes import Rectangle

#: Reference systems whose extents WMS 1.3 writes with the latitude first, here CRS:84 too.
GEOGRAPHIC = ("EPSG:4326", "CRS:84")


def plain(x: Column) -> Column:
    """A number of degrees or metres to twelve places, without an exponent and without zeros at its end."""
    return F.rtrim(F.rtrim(F.when(x.isNotNull(), F.format_string("%.12f", x + 0.0)), F.lit("0")), F.lit("."))


def wms(url: str, extent: Rectangle, layers: str, version: str = "1.3.0", crs: str = "EPSG:4326", width: int = 256, height: int = 256, image: str = "image/png") -> Column:
    """A GetMap request for an extent in the units of the reference system."""
    latest = version.startswith("1.3")
    edges = [extent.minx, extent.miny, extent.maxx, extent.maxy]
    if latest and crs in GEOGRAPHIC:
        edges = [extent.miny, extent.minx, extent.maxy, extent.maxx]
    box = F.concat(plain(edges[0]), *(part for e in edges[1:] for part in (F.lit(","), plain(e))))
    head = f"{url}?SERVICE=WMS&VERSION={version}&REQUEST=GetMap&LAYERS={layers}&{'CRS' if latest else 'SRS'}={crs}&BBOX="
    return F.concat(F.lit(head), box, F.lit(f"&WIDTH={width}&HEIGHT={height}&FORMAT={image}"))


def wmts(
    url: str, level: Column, x: Column, y: Column, layer: str, matrix_set: str, style: str = "default", image: str = "image/jpeg", labels: list[str] | None = None, hosts: list[str] | None = None, dimensions: dict[str, str] | None = None
) -> Column:
    """A GetTile request: by a template with {TileMatrix}, {TileRow} and so on, else by parameters.

    Levels beyond ``labels`` are named by their number. ``y`` is written as given. {s} is a host picked by the tile.
    """
    number = level.cast("string")
    label = F.coalesce(F.get(F.array(*map(F.lit, labels)), level), number) if labels else number
    more = dimensions or {}
    if "{tilematrix}" not in url.lower():
        head = f"{url}?SERVICE=WMTS&REQUEST=GetTile&VERSION=1.0.0&LAYER={layer}&STYLE={style}&TILEMATRIXSET={matrix_set}&TILEMATRIX="
        tail = f"&FORMAT={image}" + "".join(f"&{k}={v}" for k, v in more.items())
        return F.concat(F.lit(head), label, F.lit("&TILEROW="), y.cast("string"), F.lit("&TILECOL="), x.cast("string"), F.lit(tail))
    named = {"TileMatrix": label, "TileCol": x, "TileRow": y, "Style": F.lit(style), "Layer": F.lit(layer), "TileMatrixSet": F.lit(matrix_set)}
    values = named | {k[0].lower() + k[1:]: v for k, v in named.items()} | {k: F.lit(v) for k, v in more.items()}
    if hosts:
        values["s"] = uris.host_of_tile(x, y, hosts)
    return uris.expand(F.lit(url), values)


def tms(url: str, level: Column, x: Column, y: Column, extension: str = "png", rows: Column | None = None) -> Column:
    """A folder for each level and column; with ``rows``, the number of the level's rows, they count from the other side."""
    row = "{y}" if rows is None else "{reverseY}"
    return uris.tile_url(F.lit(f"{url.rstrip('/')}/{{z}}/{{x}}/{row}.{extension}"), level, x, y, rows)


def map_server(url: str, level: Column, x: Column, y: Column) -> Column:
    """A tile of a cached map server: level, row, column. ``y`` counts from the north."""
    return uris.expand(F.lit(f"{url.rstrip('/')}/tile/{{z}}/{{y}}/{{x}}"), {"z": level, "x": x, "y": y})


def quadkey(level: Column, x: Column, y: Column) -> Column:
    """A digit of 0 to 3 for each level, the coarsest first: the bit of the column, and twice that of the row from the north."""
    bit = lambda c, i: F.call_function("shiftright", c.cast("bigint"), (level - i).cast("int")).bitwiseAND(F.lit(1))
    digits = F.transform(F.sequence(F.lit(1), level.cast("int")), lambda i: (bit(x, i) + bit(y, i) * 2).cast("string"))
    known = x.isNotNull() & y.isNotNull()
    return F.when(known & (level > 0), F.array_join(digits, "")).when(known & (level == 0), "")


def quadkey_url(template: str, level: Column, x: Column, y: Column, hosts: list[str] | None = None) -> Column:
    """{quadkey} and {subdomain} of a template."""
    values = {"quadkey": quadkey(level, x, y)}
    if hosts:
        values["subdomain"] = uris.host_of_tile(x, y, hosts)
    return uris.expand(F.lit(template), values)
