"""Seamarks: category and colour codes, descriptions, lights and their sectors, from tags (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_match, first_tag, lookup, tag
from .text import capitalize, title

# ---- Fixed values of the map model -----------------------------------------------------------------------------------
BUOY_SHAPE = {"conical": 0, "can": 1, "spherical": 2, "pillar": 3, "spar": 4, "barrel": 5, "super-buoy": 6}
BEACON_SHAPE = {"stake": 0, "pole": 0, "post": 0, "tower": 2, "pile": 3, "lattice": 3}
LANDMARK = {
    "cairn": 0, "cemetery": 1, "chimney": 2, "dish_aerial": 3, "flagstaff": 4, "flare_stack": 5, "mast": 6, "windsock": 7, "monument": 8, "column": 9, "memorial": 10,
    "obelisk": 11, "statue": 12, "cross": 13, "dome": 14, "radar_scanner": 15, "tower": 16, "windmill": 17, "windmotor": 18, "spire": 19,
}
HARBOUR = {"fishing": 0, "marina": 1, "marina_no_facilities": 2}
MOORING = {"dolphin": 0, "deviation_dolphin": 1, "bollard": 2, "wall": 3, "post": 4, "pile": 4, "buoy": 5}
ROCK = {"covers": 0, "awash": 1}
WRECK = {"non-dangerous": 0, "dangerous": 1, "hull_showing": 2}
#: Types with one code.
PLAIN = {"light_major": 0x090003, "light_minor": 0x090103, "anchorage": 0x0E0007, "bridge": 0x0E000D, "radio_station": 0x0C000E, "platform": 0x0B0010, "production_area": 0x0B0011, "light_vessel": 0x0C0202}
COLOUR = {"grey": 0, "white": 1, "black": 2, "red": 3, "green": 4, "blue": 5, "yellow": 8}
TOP_SHAPE = {
    "cone, point up": 1, "cone, point down": 2, "sphere": 3, "2 spheres": 4, "cylinder": 5, "board": 6, "x-shape": 7, "upright cross": 8, "2 cones point together": 10,
    "2 cones base together": 11, "rhombus": 12, "2 cones up": 13, "2 cones down": 14, "square": 17, "triangle, point up": 18, "triangle, point down": 19,
}
BUOY_KIND = {"lateral": "Lateral", "cardinal": "Cardinal", "safe_water": "Safe Water", "special_purpose": "Special Purpose", "isolated_danger": "Isolated Danger"}
LATERAL = {"port": "Port-hand ", "starboard": "Starboard-hand ", "preferred_channel_port": "Preferred Channel to Port ", "preferred_channel_starboard": "Preferred Channel to Starboard "}
SPECIAL = {
    "anchorage": "Anchorage mark ", "cable": "Cable mark ", "diving": "Diving mark ", "leading": "Leading mark ", "mooring": "Mooring mark ", "no_entry": "Entry prohibited mark ",
    "notice": "Notice mark ", "outfall": "Outfall mark ", "pipeline": "Pipeline mark ", "unknown_purpose": "Mark with unknown purpose ", "warning": "General warning mark ", "yachting": "Yachting mark ",
}
HARBOUR_TEXT = {
    "bulk": "Bulk terminal", "cargo": "General cargo terminal", "container": "Container terminal", "ferry": "Ferry terminal", "fishing": "Fishing harbour", "lay_up": "Lay up vessels berth",
    "marina": "Yacht harbour/marina", "marina_no_facilities": "Yacht berths without facilities", "naval": "Naval base", "passenger": "Passenger terminal", "roro": "RoRo-terminal",
    "service_repair": "Service and repair", "shipyard": "Shipyard",
}
MOORING_TEXT = {"dolphin": "Dolphin", "bollard": "Bollard", "wall": "Tie-up wall", "post": "Post or pile", "pile": "Post or pile", "buoy": "Mooring buoy"}
WRECK_TEXT = {"dangerous": "Dangerous wreck", "non-dangerous": "Non-dangerous wreck", "hull_showing": "Wreck showing any portion of hull or superstructure"}
ANCHORAGE_TEXT = {"unrestricted": "Unrestricted anchorage", "24_hour": "Anchorage for periods up to 24 hours"}
LETTER = {"white": "W", "red": "R", "green": "G", "yellow": "Y", "blue": "Bu", "orange": "Or", "violet": "Vi"}
# ---- end of fixed values ---------------------------------------------------------------------------------------------


def own(tags: Column, kind: Column, key: str) -> Column:
    """A seamark's own tag, ``seamark:<type>:<key>``."""
    return F.try_element_at(tags, F.concat(F.lit("seamark:"), kind, F.lit(f":{key}")))


def number(value: Column) -> Column:
    """A number without a trailing ``.0``; other text as it is."""
    v = value.try_cast("double")
    return F.when(v.isNull(), value).when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string")).otherwise(v.cast("string"))


def _floating(kind: Column) -> Column:
    return F.startswith(kind, F.lit("buoy_")) | F.startswith(kind, F.lit("beacon_"))


def category(kind: Column, tags: Column) -> Column:
    """Group << 16 | shape or category << 8 | class."""
    second = F.get(F.split(kind, "_"), 1)
    group = F.when(second.isin("lateral", "cardinal"), 0xA).when(second == "safe", 0x9).otherwise(0xC)
    shape = own(tags, kind, "shape")
    cat = own(tags, kind, "category")
    code = lambda base, table, value, default: F.lit(base) + F.coalesce(lookup(table, value), F.lit(default)) * 256
    landmark = lookup(LANDMARK, F.get(F.split(F.coalesce(cat, F.lit("")), ";"), 0))
    return first_match([
        (F.startswith(kind, F.lit("buoy_")), group * 65536 + F.coalesce(lookup(BUOY_SHAPE, shape), F.lit(3)) * 256),
        (F.startswith(kind, F.lit("beacon_")), group * 65536 + F.coalesce(lookup(BEACON_SHAPE, shape), F.lit(3)) * 256 + 1),
        (kind == "landmark", F.coalesce(F.lit(0x0A0004) + landmark * 256, F.lit(0x090003))), (kind == "harbour", code(0x090006, HARBOUR, cat, 3)), (kind == "mooring", code(0x0F0008, MOORING, cat, 0)),
        (kind == "rock", code(0x0F000C, ROCK, own(tags, kind, "water_level"), 2)), (kind == "wreck", code(0x0F0009, WRECK, cat, 1)), (F.startswith(kind, F.lit("signal_station")), F.lit(0x0C000F)),
        (F.lit(True), lookup(PLAIN, kind)),
    ]).cast("long")


def _colours(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda c: lookup(COLOUR, c)), lambda c: c.isNotNull())


def _shifted(colours: Column, first: int) -> Column:
    at = lambda i: F.coalesce(F.get(colours, i), F.lit(0)).cast("long") * (1 << (first + 4 * i))
    return at(0) + at(1)


def body_colour(kind: Column, tags: Column) -> Column:
    """Bits 0-3 pattern, 4-6 number of colours, then two colours of four bits; 0 for other marks than buoys and beacons."""
    colours = _colours(own(tags, kind, "colour"))
    pattern = F.when(own(tags, kind, "colour_pattern") == "vertical", 4).otherwise(0)
    return F.when(_floating(kind) & (F.size(colours) > 0), pattern + F.size(colours) * 16 + _shifted(colours, 7)).otherwise(0).cast("long")


def topmark(tags: Column) -> Column:
    colours = _colours(tag(tags, "seamark:topmark:colour"))
    return (F.coalesce(lookup(TOP_SHAPE, tag(tags, "seamark:topmark:shape")), F.lit(0)) + F.least(F.size(colours), F.lit(3)) * 128 + _shifted(colours, 9)).cast("long")


def description(kind: Column, tags: Column) -> Column:
    cat = F.nullif(own(tags, kind, "category"), F.lit(""))
    head = F.get(F.split(kind, "_"), 0)
    sub = F.substring(kind, F.length(head) + 2, F.length(kind))
    base = F.concat(F.coalesce(lookup(BUOY_KIND, sub), sub), F.lit(" "), capitalize(head))
    floating = F.when(sub == "lateral", F.concat(F.coalesce(lookup(LATERAL, cat), F.lit("")), base)).when((sub == "cardinal") & cat.isNotNull(), F.concat(capitalize(cat), F.lit(" "), base)) \
        .when(sub == "special_purpose", F.concat(F.coalesce(lookup(SPECIAL, cat), F.lit("")), base)).otherwise(base)
    light = first_tag(tags, "seamark:light:category", "seamark:light:1:category")
    kinds = F.array_join(F.transform(F.split(light, ";"), lambda x: F.when(x == "floodlight", "flood").otherwise(F.replace(x, F.lit("_"), F.lit(" ")))), ",")
    plain = F.replace(kind, F.lit("_"), F.lit(" "))
    ports = F.filter(F.transform(F.split(F.coalesce(cat, F.lit("")), ";"), lambda x: lookup(HARBOUR_TEXT, x)), lambda x: x.isNotNull())
    or_plain = lambda text, default: F.when(cat.isNotNull(), text).otherwise(default)
    return (F.when(_floating(kind), floating)
            .when(kind.isin("light_major", "light_minor"), F.when(light.isNull(), capitalize(plain)).otherwise(F.concat(capitalize(kinds), F.lit(" "), plain)))
            .when(kind == "landmark", capitalize(F.get(F.split(cat, ";"), 0)))
            .when(kind == "harbour", F.when(F.size(ports) == 0, "Harbour").when(F.size(ports) == 1, F.concat(F.get(ports, 0), F.lit("\n"))).otherwise(F.array_join(F.transform(ports, lambda p: F.concat(F.lit("- "), p, F.lit("\n"))), "")))
            .when(kind == "mooring", F.coalesce(lookup(MOORING_TEXT, cat), F.lit("Dolphin"))).when(kind == "rock", "Rock").when(kind == "wreck", lookup(WRECK_TEXT, cat)).when(kind == "anchorage", lookup(ANCHORAGE_TEXT, cat))
            .when(kind == "bridge", or_plain(F.concat(capitalize(cat), F.lit(" bridge")), "Bridge")).when(kind == "platform", or_plain(F.concat(F.lit("Platform("), cat, F.lit(")")), "Platform"))
            .when(kind == "radio_station", F.when(cat == "dgps", "Differential GPS").otherwise("Radio station"))
            .when(kind == "signal_station_traffic", or_plain(F.concat(F.lit("Traffic Signal Station: "), title(cat)), "Traffic Signal Station"))
            .when(kind == "signal_station_warning", "Warning Signal Stations").when(kind == "light_vessel", "Light vessel"))


def lights(tags: Column) -> Column:
    """``array<map<string,string>>``: numbered lights in order, else the one unnumbered light, keys without their prefix."""
    pattern = r"^seamark:light:([0-9]+):"
    found = F.array_sort(F.array_distinct(F.transform(F.filter(F.map_keys(tags), lambda k: k.rlike(pattern)), lambda k: F.regexp_extract(k, pattern, 1).try_cast("long"))))
    below = lambda prefix: F.map_from_entries(F.transform(
        F.filter(F.map_entries(tags), lambda e: F.startswith(e.getField("key"), prefix)),
        lambda e: F.struct(F.substring(e.getField("key"), F.length(prefix) + 1, F.length(e.getField("key"))).alias("key"), e.getField("value").alias("value"))))
    single = F.map_filter(below(F.lit("seamark:light:")), lambda k, v: ~F.startswith(k, F.lit("reference")))
    return F.when(F.size(found) > 0, F.transform(found, lambda i: below(F.concat(F.lit("seamark:light:"), i.cast("string"), F.lit(":"))))) \
        .when(F.size(single) > 0, F.array(single)).otherwise(F.array().cast("array<map<string,string>>"))


def _get(light: Column, key: str) -> Column:
    return F.nullif(F.try_element_at(light, F.lit(key)), F.lit(""))


def light_string(ls: Column) -> Column:
    """Character, colours, period, height, range and category, as in ``Oc.WRG.12s9-12M``."""
    first, last = F.get(ls, 0), F.element_at(ls, -1)
    named = F.flatten(F.transform(ls, lambda x: F.split(F.coalesce(_get(x, "colour"), F.lit("")), ";")))
    letters = F.array_join(F.transform(F.filter(F.array(*map(F.lit, LETTER)), lambda c: F.array_contains(named, c)), lambda c: lookup(LETTER, c)), "")
    ranges = F.array_sort(F.filter(F.transform(ls, lambda x: F.when(_get(x, "range").rlike(r"^[0-9.]+$"), _get(x, "range").try_cast("double"))), lambda r: r.isNotNull()))
    low, high = F.get(ranges, 0).cast("long").cast("string"), F.get(ranges, F.size(ranges) - 1).cast("long").cast("string")
    alone = (F.size(ls) == 1) & F.try_element_at(first, F.lit("sector_start")).isNull()
    empty = F.lit("")
    rest = F.concat(F.coalesce(F.concat(number(_get(first, "period")), F.lit("s")), empty), F.when(alone, F.coalesce(F.concat(number(_get(first, "height")), F.lit("m")), empty)).otherwise(empty),
                    F.when(F.size(ranges) > 0, F.concat(F.when(low == high, low).otherwise(F.concat(low, F.lit("-"), high)), F.lit("M"))).otherwise(empty))
    cat = _get(last, "category")
    return F.when(F.size(ls) > 0, F.concat(F.coalesce(_get(first, "character"), empty), F.lit("."), letters, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(empty),
                                           F.coalesce(F.concat(F.lit("("), F.upper(F.substring(cat, 1, 1)), F.substring(cat, 2, 1 << 30), F.lit(")")), empty)))


def sectors(ls: Column) -> Column:
    """``array<struct<colour, seq, start, end, radius, label>>`` by colour, then by the light's order; radius 0 without angles."""
    angle = lambda d: F.floor(F.pmod(d + 180.0, F.lit(360.0)) * 4096.0 / 360.0) / 10.0

    def one(light: Column, i: Column) -> Column:
        name = F.get(F.split(F.coalesce(_get(light, "colour"), F.lit("")), ";"), 0)
        a, b = _get(light, "sector_start").try_cast("double"), _get(light, "sector_end").try_cast("double")
        whole = a.isNotNull() & b.isNotNull()
        label = F.concat(F.coalesce(_get(light, "character"), F.lit("")), F.lit("."), F.coalesce(lookup(LETTER, _get(light, "colour")), F.lit("")), F.coalesce(F.concat(F.lit("."), number(_get(light, "period")), F.lit("s")), F.lit("")))
        return F.struct(F.when(name == "amber", 9).otherwise(F.coalesce(lookup(COLOUR, name), F.lit(0))).alias("colour"), i.alias("seq"), F.when(whole, angle(a)).otherwise(0.0).alias("start"), F.when(whole, angle(b)).otherwise(0.0).alias("end"),
                        F.when(whole, 370).otherwise(0).alias("radius"), F.when(whole, label).otherwise("").alias("label"))

    return F.array_sort(F.transform(ls, one))


def _fog(tags: Column) -> Column:
    get = lambda k: first_tag(tags, f"seamark:fog_signal:{k}")
    return F.concat(capitalize(get("category")), F.coalesce(F.concat(F.lit("("), get("group"), F.lit(")")), F.lit("")), F.coalesce(F.concat(number(get("period")), F.lit("s")), F.lit("")))


def _racon(tags: Column) -> Column:
    return F.when(tag(tags, "seamark:radar_transponder:category") == "racon", F.concat(F.lit("Racon("), F.coalesce(tag(tags, "seamark:radar_transponder:group"), F.lit("")), F.lit(")")))


def attributes(kind: Column, tags: Column, ls: Column) -> Column:
    """``NNvalue|NNvalue`` by code."""
    first = F.get(ls, 0)
    level = F.nullif(own(tags, kind, "water_level"), F.lit(""))
    parts = [
        ("01", first_tag(tags, "website", "contact:website")), ("02", first_tag(tags, "phone", "contact:phone")), ("04", first_tag(tags, "internet_access")), ("06", first_tag(tags, "wheelchair")),
        ("11", first_tag(tags, "description")), ("16", first_tag(tags, "fax")), ("17", first_tag(tags, "email", "contact:email")), ("18", first_tag(tags, "operator")), ("19", description(kind, tags)),
        ("20", first_tag(tags, "seamark:information")), ("21", _racon(tags)), ("23", _fog(tags)), ("24", light_string(ls)), ("25", first_tag(tags, "seamark:light:reference")),
        ("26", F.nullif(own(tags, kind, "system"), F.lit(""))), ("27", first_tag(tags, "port_of_entry")), ("35", number(first_tag(tags, "seamark:landmark:height"))), ("36", number(_get(first, "height"))),
        ("37", _get(first, "exhibition")), ("45", F.when(kind == "rock", F.coalesce(level, F.lit("submerged"))).when(kind == "wreck", level)),
    ]
    return F.array_join(F.array_compact(F.array(*[F.concat(F.lit(code), value) for code, value in parts])), "|")


def label(kind: Column, tags: Column, ls: Column) -> Column:
    """Label line: fog signal and racon, station marks, clearance, light."""
    cat = F.nullif(own(tags, kind, "category"), F.lit(""))
    zero = lambda value: F.concat(F.lit("0"), value)
    parts = F.array(zero(_fog(tags)), zero(_racon(tags)), F.when(F.startswith(kind, F.lit("signal_station_warning")), "7SS"),
                    F.when(kind == "signal_station_traffic", F.concat(F.lit("("), title(cat), F.lit(")"))),
                    F.when(kind == "bridge", F.concat(F.lit("4"), number(first_tag(tags, "seamark:bridge:clearance_height")))), F.concat(F.lit("5"), light_string(ls)))
    return F.array_join(F.array_compact(parts), "|")
