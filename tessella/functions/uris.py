"""URI functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def is_absolute(u: Column) -> Column:
    return u.rlike(_SCHEME)


def is_data(u: Column) -> Column:
    return F.lower(u).startswith("data:")


def without_query(u: Column) -> Column:
    return F.regexp_replace(u, r"[?#].*$", "")


def query(u: Column) -> Column:
    """What follows the question mark, without a fragment; NULL for none."""
    found = F.regexp_extract(u, r"\?([^#]*)", 1)
    return F.when(F.instr(u, "?") > 0, found)


def file_name(u: Column) -> Column:
    return F.element_at(F.split(without_query(u), "/"), -1)


def extension(u: Column) -> Column:
    """Lower-case extension of the last part, without its dot; empty for none."""
    return F.lower(F.regexp_extract(file_name(u), r"\.([^.]+)$", 1))


def host(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(u: Column) -> Column:
    return F.regexp_replace(without_query(u), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")


def folder(u: Column) -> Column:
    """Up to and with the last stroke of the path."""
    return F.regexp_replace(without_query(u), r"[^/]*$", "")


def normal_path(p: Column) -> Column:
    """A path without its '.' and '..' parts."""
    parts = F.split(p, "/")
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, start, step), "/")


def resolve(base: Column, key: Column) -> Column:
    """A reference as seen from a base: absolute ones stay, rooted ones take the base's host, others its folder."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(key, r"([?#].*)$", 1)
    bare = without_query(key)
    rooted = F.concat(root, normal_path(bare))
    relative = F.concat(root, normal_path(F.concat(F.regexp_replace(path(base), r"[^/]*$", ""), bare)))
    return F.when(is_absolute(key) | is_data(key), key).when(key == "", base).when(key.startswith("//"), F.concat(F.regexp_extract(base, _SCHEME, 0), key)).otherwise(F.concat(F.when(key.startswith("/"), rooted).otherwise(relative), tail))


def expand(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {name} replaced; names that are not given stay."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def host_of_tile(x: Column, y: Column, hosts: list[str]) -> Column:
    """One of a service's hosts, always the same one for a tile."""
    return F.element_at(F.array(*map(F.lit, hosts)), (F.pmod(x + y, F.lit(len(hosts))) + 1).cast("int"))


def tile_url(template: Column, level: Column, x: Column, y: Column, rows: Column | None = None, hosts: list[str] | None = None) -> Column:
    """{z}, {x}, {y}, {reverseY} and {s} of an imagery template; the host is picked by the tile, always the same one."""
    values = {"z": level, "x": x, "y": y}
    if rows is not None:
        values["reverseY"] = rows - 1 - y
    if hosts:
        values["s"] = host_of_tile(x, y, hosts)
    return expand(template, values)


def with_parameter(u: Column, name: str, value: Column) -> Column:
    """A query parameter set, in place of one of that name."""
    bare = F.regexp_replace(F.regexp_replace(u, rf"([?&]){name}=[^&#]*&?", "$1"), r"[?&]$", "")
    return F.concat(bare, F.when(F.instr(bare, "?") > 0, "&").otherwise("?"), F.lit(name + "="), F.url_encode(value.cast("string")))
