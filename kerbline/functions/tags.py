"""OpenStreetMap tags as column expressions: predicates, access permissions and travel modes.

Every function takes `tag`, a function from a key to a string column (null where the tag is missing): `from_map("tags")` for a map
column, or any lookup over ordinary columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Tag = Callable[[str], Column]

# Permission bits, mode bits and tag values that stored maps use.
NONE, PEDESTRIAN, BICYCLE, CAR, ALL = 0, 1, 2, 4, 7
MODES = {"BICYCLE": 1, "WALK": 2, "CAR": 4, "BUS": 16, "TRAM": 32, "SUBWAY": 64, "RAIL": 128, "FERRY": 256, "CABLE_CAR": 512, "GONDOLA": 1024, "FUNICULAR": 2048, "AIRPLANE": 4096}
TRANSIT = sum(bit for bit in MODES.values() if bit >= 16)
ALLOWING = ("yes", "1", "true", "designated", "official", "permissive", "unknown")
DENYING = ("no", "license")
UNROUTABLE = ("conveyer", "proposed", "construction", "raceway", "unbuilt")


def from_map(name: str) -> Tag:
    return lambda key: F.col(name)[key]


def from_columns(names: list[str]) -> Tag:
    """Tags as columns of the same names; other keys are missing."""
    return lambda key: F.col(key) if key in names else F.lit(None).cast("string")


def _is(x: Column, *values: str) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False))


def secure_boolean(x: Column) -> Column:
    return _is(x, "true")


def is_true(tag: Tag, key: str) -> Column:
    return _is(tag(key), "yes", "1", "true")


def is_false(tag: Tag, key: str) -> Column:
    return _is(tag(key), "no", "0", "false")


def explicitly_allowed(tag: Tag, mode: str) -> Column:
    return _is(tag(mode), *ALLOWING)


def explicitly_denied(tag: Tag, mode: str) -> Column:
    return _is(tag(mode), *DENYING, *(["use_sidepath"] if mode == "bicycle" else []))


def general_access_denied(tag: Tag) -> Column:
    return _is(tag("access"), *DENYING)


def routable_entity(tag: Tag) -> Column:
    platform = _is(tag("public_transport"), "platform") | _is(tag("railway"), "platform")
    return tag("highway").isNotNull() | (platform & ~_is(tag("usage"), "tourism"))


def routable_highway(tag: Tag) -> Column:
    return ~_is(tag("highway"), *UNROUTABLE)


def routable_way(tag: Tag) -> Column:
    some = F.lit(False)
    for mode in ("motorcar", "bicycle", "foot", "motor_vehicle"):
        some = some | explicitly_allowed(tag, mode)
    return routable_entity(tag) & routable_highway(tag) & (~general_access_denied(tag) | some)


def dismount(tag: Tag) -> Column:
    return _is(tag("bicycle"), "dismount") | _is(tag("cycleway"), "dismount")


def under_construction(tag: Tag) -> Column:
    return _is(tag("highway"), "construction") | _is(tag("cycleway"), "construction")


def park_and_ride(tag: Tag) -> Column:
    return _is(tag("amenity"), "parking") & (_is(tag("parking"), "park_and_ride") | F.coalesce(tag("park_ride") != "no", F.lit(False)))


def bike_parking(tag: Tag) -> Column:
    return _is(tag("amenity"), "bicycle_parking") & ~_is(tag("access"), "private", "no")


def is_stop(tag: Tag) -> Column:
    return _is(tag("highway"), "bus_stop") | _is(tag("railway"), "tram_stop", "station", "halt") | _is(tag("amenity"), "bus_station")


def is_bollard(tag: Tag) -> Column:
    return _is(tag("barrier"), "bollard")


def is_elevator(tag: Tag) -> Column:
    return _is(tag("highway"), "elevator")


def is_bike_rental(tag: Tag) -> Column:
    return _is(tag("amenity"), "bicycle_rental")


def way_flags(tag: Tag, nodes: Column) -> dict[str, Column]:
    """The predicates of a way; nodes is its number of nodes."""
    opposite = F.lit(False)
    for key in ("cycleway", "cycleway:left", "cycleway:right"):
        opposite = opposite | F.coalesce(F.startswith(tag(key), F.lit("opposite")), F.lit(False))
    return {
        "steps": _is(tag("highway"), "steps"), "roundabout": _is(tag("junction"), "roundabout"),
        "oneway_forward": is_true(tag, "oneway"), "oneway_reverse": _is(tag("oneway"), "-1"),
        "bike_forward": is_true(tag, "oneway:bicycle") | is_false(tag, "bicycle:backwards"), "bike_reverse": _is(tag("oneway:bicycle"), "-1"),
        "sidepath_forward": _is(tag("bicycle:forward"), "use_sidepath"), "sidepath_reverse": _is(tag("bicycle:backward"), "use_sidepath"),
        "opposable": opposite, "area": (_is(tag("area"), "yes") | _is(tag("amenity"), "parking", "bicycle_parking")) & (nodes > 2),
    }


# Permission masks.


def add(mask: Column, bits: int) -> Column:
    return mask.bitwiseOR(F.lit(bits))


def remove(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(~bits))


def allows(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits)) != 0


def _bits(flags: dict[int, Column]) -> Column:
    """The mask of the bits whose flags hold. Each flag stands in it once, so a mask made of masks stays small."""
    return sum((F.when(flag, bit).otherwise(0) for bit, flag in flags.items()), F.lit(0))


def _entity_flags(tag: Tag, default: int) -> dict[int, Column]:
    """Per permission bit whether an entity has it: a denied mode has none, an allowed one has, another as access in general says."""
    keys = {CAR: ("motorcar", "motor_vehicle"), BICYCLE: ("bicycle",), PEDESTRIAN: ("foot",)}
    either = lambda test, names: reduce(Column.__or__, (test(tag, m) for m in names))
    closed, building = general_access_denied(tag), under_construction(tag)
    return {
        bit: F.when(building | either(explicitly_denied, names), False).when(either(explicitly_allowed, names), True).otherwise(~closed & F.lit(default & bit != 0))
        for bit, names in keys.items()
    }


def entity_permissions(tag: Tag, default: int = ALL) -> Column:
    return _bits(_entity_flags(tag, default))


def way_permissions(tag: Tag, default: int = ALL) -> Column:
    flags = _entity_flags(tag, default)
    foot = F.when(explicitly_allowed(tag, "foot"), True).when(explicitly_denied(tag, "foot"), False).otherwise(flags[PEDESTRIAN])
    bike = (explicitly_allowed(tag, "bicycle") & ~dismount(tag)) | flags[BICYCLE]
    return _bits({**flags, PEDESTRIAN: foot, BICYCLE: bike})


def direction_permissions(tag: Tag, mask: Column) -> tuple[Column, Column]:
    """Front and back masks of a way with a permission mask."""
    f = way_flags(tag, F.lit(0))
    car, bike, foot = (allows(mask, bit) for bit in (CAR, BICYCLE, PEDESTRIAN))
    anyway = (is_false(tag, "oneway:bicycle") | is_true(tag, "bicycle:backwards")) & bike
    against, along = f["oneway_reverse"], f["oneway_forward"] | f["roundabout"]
    front = ((bike & ~against & ~f["bike_reverse"]) | anyway) & ~f["sidepath_forward"]
    back = (((bike & ~along & ~f["bike_forward"]) | anyway) & ~f["sidepath_reverse"]) | f["opposable"]
    return _bits({CAR: car & ~against, BICYCLE: front, PEDESTRIAN: foot}), _bits({CAR: car & ~along, BICYCLE: back, PEDESTRIAN: foot})


def mode_mask(names: Column) -> Column:
    """The mask of a comma-separated list of modes; unknown names count nothing."""
    bit = lambda n: F.coalesce(F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])[F.upper(F.trim(n))], F.lit(0))
    return F.aggregate(F.split(F.coalesce(names, F.lit("")), ","), F.lit(0), lambda m, n: m.bitwiseOR(bit(n)))


def is_transit(mask: Column) -> Column:
    return mask.bitwiseAND(F.lit(TRANSIT)) != 0


def level(spec: Column) -> Column:
    """struct<floor, altitude, short_name, long_name, reliable> of a level tag `short=long@altitude`, of which all but short may be missing.

    A leading plus sign is dropped. The floor is the short name's number, else the long name's, else the altitude by three metres
    a floor (not reliable). Null or empty is the default level 0.
    """
    spec = F.coalesce(spec, F.lit(""))
    altitude = F.regexp_extract(spec, "@([^@]*)$", 1).try_cast("double")
    name = F.regexp_replace(spec, "@[^@]*$", "")
    plain = lambda x: F.regexp_replace(F.trim(x), r"^\+", "")
    short, long_ = plain(F.substring_index(name, "=", 1)), plain(F.when(F.contains(name, F.lit("=")), F.regexp_extract(name, "=(.*)$", 1)).otherwise(name))
    number = F.coalesce(F.regexp_extract(short, "^(-?[0-9]{1,6})$", 1).try_cast("int"), F.regexp_extract(long_, "^(-?[0-9]{1,6})$", 1).try_cast("int"))
    floor = F.when(spec == "", 0).otherwise(F.coalesce(number, (altitude / 3).cast("int"), F.lit(0)))
    return F.struct(floor.alias("floor"), F.coalesce(altitude, F.lit(0.0)).alias("altitude"), short.alias("short_name"), long_.alias("long_name"), (number.isNotNull() | (spec == "")).alias("reliable"))
