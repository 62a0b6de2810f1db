"""Tag rules: classes, types and attribute bits of entities, compiled from rule tables into Column expressions.

Tags are a ``MAP<STRING,STRING>`` column. Nothing here is a UDF; rules are `when` chains and map literals.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values of the map model: classes, categories, types -------------------------------------------------------
ROAD_CLASS = {
    "motorway": 0, "motorway_link": 0, "trunk": 1, "trunk_link": 1, "primary": 2, "secondary": 3, "primary_link": 3,
    "secondary_link": 4, "tertiary": 6, "tertiary_link": 6, "service": 7, "residential": 7, "unclassified": 7,
    "living_street": 7, "road": 7, "pedestrian": 8, "cycleway": 10, "footway": 11, "track": 12, "path": 13,
    "bridleway": 13, "steps": 14,
}
FERRY = 9
ROAD_CATEGORY = {0: 18, 1: 18, 2: 18, 3: 18, 4: 18, 6: 10, 8: 16, 9: 6, 10: 16, 11: 16, 12: 5, 13: 5, 14: 16}
PAVED = ("asphalt", "paved", "paving_stones", "concrete", "concrete:plates", "concrete:lanes", "chipseal")
COBBLES = ("sett", "cobblestone", "unhewn_cobblestone")
RESTRICTED = ("private", "no", "destination", "customers", "forestry")
CYCLE_ON_ROAD = ("track", "lane", "shared_lane", "separate", "opposite_lane", "opposite_track", "opposite", "share_busway", "crossing")
RAIL = ("rail", "light_rail", "subway", "narrow_gauge", "disused", "tram", "preserved", "miniature")
MAN_MADE_LINE = {"pier": 4, "groyne": 5, "breakwater": 6}
WATERWAY = ("stream", "river", "canal")
NAMED_WATERWAY = ("ditch", "drain")
RELIGION = {"christian": 0x1D, "muslim": 0x1E, "buddhist": 0x1F, "hindu": 0x20, "shinto": 0x21, "taoist": 0x22, "sikh": 0x23, "jewish": 0x24}
SMALL_CRAFT = {
    "visitor_berth": 0x37, "nautical_club": 0x38, "boat_hoist": 0x39, "boatyard": 0x3A, "chandler": 0x3B, "water_tap": 0x3C, "fuel_station": 0x3D,
    "electricity": 0x3E, "showers": 0x3F, "laundrette": 0x40, "toilets": 0x41, "pump-out": 0x42, "slipway": 0x43, "visitors_mooring": 0x44,
}
LIFTS = {"cable_car": 0x29, "gondola": 0x2A, "chair_lift": 0x2B, "mixed_lift": 0x2C, "t-bar": 0x2D, "j-bar": 0x2E, "platter": 0x2F, "rope_tow": 0x30, "magic_carpet": 0x31}
HISTORIC_SKIP = ("railway", "hollow_way", "bunker", "wall", "aircraft", "no")
#: Key, value, type of point of interest; the first match wins.
POI_RULES = (
    ("amenity", "fuel", 0x0B), ("amenity", "bicycle_rental", 0x26), ("shop", "bicycle", 0x01), ("amenity", "bank", 0x00), ("amenity", "atm", 0x03),
    ("amenity", "pharmacy", 0x0C), ("amenity", "doctors", 0x05), ("amenity", "hospital", 0x08), ("amenity", "police", 0x0D), ("emergency", "defibrillator", 0x06),
    ("amenity", "marketplace", 0x0A), ("amenity", "bus_station", 0x25), ("amenity", "cafe", 0x02), ("amenity", "bar", 0x02), ("amenity", "pub", 0x02),
    ("amenity", "restaurant", 0x0E), ("amenity", "fast_food", 0x0E), ("amenity", "shelter", 0x36), ("tourism", "museum", 0x49), ("tourism", "gallery", 0x49),
    ("tourism", "zoo", 0x4A), ("tourism", "aquarium", 0x4A), ("tourism", "attraction", 0x09), ("tourism", "viewpoint", 0x0F), ("tourism", "information", 0x13),
    ("tourism", "camp_site", 0x14), ("tourism", "hotel", 0x15), ("tourism", "hostel", 0x15), ("tourism", "motel", 0x15), ("tourism", "alpine_hut", 0x33),
    ("shop", "supermarket", 0x11), ("shop", "department_store", 0x04), ("shop", "convenience", 0x10), ("shop", "bakery", 0x10), ("shop", "butcher", 0x10),
    ("shop", "kiosk", 0x10), ("leisure", "sports_centre", 0x12), ("leisure", "stadium", 0x12), ("railway", "station", 0x1C), ("railway", "halt", 0x1C),
    ("railway", "tram_stop", 0x1A), ("railway", "subway_entrance", 0x1B), ("highway", "bus_stop", 0x19),
)
#: Code and keys of a point's attributes; the first non-empty key counts.
POI_ATTRIBUTES = (
    ("01", ("website", "url", "contact:website")), ("02", ("phone", "contact:phone")), ("03", ("opening_hours",)), ("04", ("internet_access",)),
    ("05", ("smoking",)), ("06", ("wheelchair",)), ("07", ("beds",)), ("08", ("rooms",)), ("09", ("cuisine",)), ("10", ("capacity",)),
    ("11", ("description",)), ("16", ("fax", "contact:fax")), ("17", ("email", "contact:email")), ("18", ("operator",)), ("74", ("access",)),
)
#: Land use, natural and man-made values by area class; water and settlement areas have arrays of their own.
WATER, SETTLEMENT = "c6", "c3"
LANDUSE = (
    (("residential",), SETTLEMENT, None), (("forest", "scrub"), "c5", 6), (("farmland", "farmyard", "allotments", "orchard", "vineyard"), "c5", 8),
    (("meadow", "grass", "greenfield", "village_green", "greenhouse_horticulture"), "c5", 7), (("industrial", "quarry", "construction", "railway", "landfill"), "c5", 4),
    (("commercial", "retail"), "c5", 1), (("military",), "c5", 2), (("cemetery",), "c5", 3), (("recreation_ground",), "c5", 5), (("basin", "reservoir", "aquaculture"), WATER, None),
    (("plant_nursery", "brownfield", "animal_keeping", "fishfarm", "garages", "harbour", "religious", "scout_camp"), "c5", 0),
)
NATURAL = ((("water",), WATER, None), (("wetland",), "c5", 10), (("beach",), "c5", 9), (("heath",), "c5", 6))
MAN_MADE_AREA = ((("pier",), "c5", 11), (("groyne",), "c5", 16), (("breakwater",), "c5", 17))
LEISURE_AREA = (
    "park", "pitch", "playground", "garden", "sports_centre", "golf_course", "track", "miniature_golf", "marina", "common", "dog_park", "stadium", "horse_riding",
    "recreation_ground", "water_park", "fitness_station", "swimming_pool", "fishing", "sports_hall", "outdoor_seating", "slipway", "soccer_golf", "disc_golf_course",
)
#: Land cover: key, values, class name; of an area's tags the first match in tag order counts.
COVER = (
    ("landuse", ("farmland", "farmyard", "orchard", "vineyard", "allotments"), "farm"), ("landuse", ("residential", "commercial", "industrial", "retail", "construction", "railway", "brownfield"), "urban"),
    ("landuse", ("quarry",), "rock"), ("natural", ("heath", "scrub", "grassland", "fell", "moor"), "heath"), ("landuse", ("forest",), "forest"), ("natural", ("wood",), "forest"),
    ("natural", ("wetland",), "wet"), ("natural", ("bare_rock", "scree", "glacier"), "rock"), ("natural", ("shingle", "sand", "beach"), "sand"), ("natural", ("water",), "water"),
    ("waterway", ("riverbank",), "water"), ("landuse", ("reservoir", "basin"), "water"),
)
#: Draw order of the area classes in a cell.
CLASS_ORDER = (4, 3, 10, 1, 0, 9, 11, 2, 5, 17, 8, 6, 7, 16)
PLACES = ("city", "town", "village", "hamlet", "suburb", "quarter", "neighbourhood", "locality", "isolated_dwelling", "borough", "island", "islet", "farm")
ADMIN_LEVELS = (4, 5, 6, 7, 8)
#: An area has one of these keys.
AREA_KEYS = ("landuse", "natural", "leisure", "man_made", "waterway", "water", "military", "aeroway", "amenity", "tourism")
# ---- end of fixed values ---------------------------------------------------------------------------------------------


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def first_tag(tags: Column, *keys: str) -> Column:
    """The first of the keys with a non-empty value."""
    return F.coalesce(*[F.nullif(tag(tags, k), F.lit("")) for k in keys])


def lookup(table: dict, value: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal, value)


def first_match(rules: list[tuple[Column, Column]]) -> Column:
    """The value of the first rule that holds, else null."""
    return F.coalesce(*[F.when(cond, value) for cond, value in rules])


def _is(value: Column, *options: str) -> Column:
    return F.coalesce(value.isin(*options), F.lit(False))


def road_class(tags: Column) -> Column:
    return (F.when(_is(tag(tags, "area"), "yes"), F.lit(None))
            .when(_is(tag(tags, "route"), "ferry") & tag(tags, "highway").isNull(), FERRY)
            .otherwise(lookup(ROAD_CLASS, tag(tags, "highway"))))


def road_category(cls: Column, tags: Column) -> Column:
    return F.when(cls == 7, F.when(_is(tag(tags, "highway"), "service"), 6).otherwise(10)).otherwise(lookup(ROAD_CATEGORY, cls))


def _bits(parts: list[tuple[Column, int]]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(value.cast("long"), at) for value, at in parts])


def tag_flags(tags: Column) -> Column:
    """Attribute bits of a road, as BIGINT (bit 31 is in use)."""
    get = lambda k: tag(tags, k)
    roundabout = _is(get("junction"), "roundabout")
    surface = F.when(get("surface").isNull(), 3).when(get("surface").isin(*PAVED), 1).when(get("surface").isin(*COBBLES), 2).otherwise(0)
    on_road = _is(get("cycleway"), *CYCLE_ON_ROAD)
    bicycle = F.when(_is(get("bicycle"), "no"), 0).when(_is(get("bicycle"), "designated") | on_road, 3).when(_is(get("bicycle"), "yes", "permissive"), 2).otherwise(1)
    lanes = F.least(F.greatest(F.coalesce(F.when(get("lanes").rlike(r"^[+-]?[0-9]{1,18}$"), get("lanes").try_cast("long")), F.lit(0)), F.lit(0)), F.lit(7))
    return _bits([
        (roundabout, 0), (_is(get("access"), *RESTRICTED), 4), (get("mtb:scale").isNotNull(), 5), (_is(get("highway"), "bridleway"), 6), (surface, 7), (bicycle, 9),
        (_is(get("oneway"), "yes", "true", "1") | roundabout, 11), (lanes, 13), (on_road, 29), (_is(get("bicycle"), "dismount"), 30),
        (_is(get("foot"), "yes", "designated", "permissive"), 31),
    ])


def route_bits(route: Column, network: Column) -> Column:
    """Bits that one route relation sets on its ways; a way's bits are the OR of its relations'."""
    cycle = _is(route, "bicycle", "mtb")
    return _bits([(cycle & _is(network, "lcn"), 1), (cycle & _is(network, "rcn"), 2), (cycle & _is(network, "ncn"), 3), (cycle & _is(network, "icn"), 27), (_is(route, "hiking", "foot"), 18)])


def passable(tags: Column, cls: Column) -> Column:
    """``struct<forward, backward>``: directions open to bicycles."""
    get = lambda k: tag(tags, k)
    way = lambda f, b: F.struct(F.lit(f).alias("forward"), F.lit(b).alias("backward"))
    return (F.when(F.coalesce(cls == FERRY, F.lit(False)) | _is(get("oneway:bicycle"), "no") | _is(get("cycleway"), "opposite", "opposite_lane", "opposite_track"), way(True, True))
            .when(_is(get("oneway"), "-1"), way(False, True))
            .when(_is(get("oneway"), "yes", "true", "1") | _is(get("junction"), "roundabout"), way(True, False))
            .otherwise(way(True, True)))


def multilingual(tags: Column) -> Column:
    """The name, or ``[DANname¦GERname¦ENGname]`` where German or English names differ from it."""
    name = F.coalesce(tag(tags, "name"), F.lit(""))
    other = lambda code, key: F.when((first_tag(tags, key) != name), F.concat(F.lit(code), first_tag(tags, key)))
    parts = F.array_compact(F.array(other("GER", "name:de"), other("ENG", "name:en")))
    return F.when((name == "") | (F.size(parts) == 0), name).otherwise(F.concat(F.lit("[DAN"), name, F.lit("¦"), F.array_join(parts, "¦"), F.lit("]")))


def line_type(tags: Column) -> Column:
    """``struct<kind, type, name>`` of a line that is no road: kind A3 has no name, A4 has one."""
    get = lambda k: tag(tags, k)
    line = lambda kind, code, name=None: F.struct(F.lit(kind).alias("kind"), (F.lit(code) if isinstance(code, int) else code).cast("int").alias("type"), (F.lit(None).cast("string") if name is None else name).alias("name"))
    seamark = get("seamark:type")
    degrees = F.try_element_at(tags, F.concat(F.lit("seamark:"), seamark, F.lit(":orientation")))
    rounded = F.coalesce(F.rint(degrees.try_cast("double")).cast("long").cast("string"), F.lit(""))
    named = F.coalesce(get("name") != "", F.lit(False))
    return first_match([
        (_is(get("railway"), *RAIL), line("A3", 0)), (_is(get("man_made"), *MAN_MADE_LINE), line("A3", lookup(MAN_MADE_LINE, get("man_made")))), (_is(get("power"), "line"), line("A3", 10)),
        (_is(get("waterway"), *WATERWAY) | (_is(get("waterway"), *NAMED_WATERWAY) & named), line("A4", 7, multilingual(tags))),
        (_is(seamark, "navigation_line"), line("A4", 8, F.concat(rounded, F.lit("(leading)")))), (_is(seamark, "recommended_track"), line("A4", 9, F.concat(rounded, F.lit("(fixed_marks)")))),
    ])


def poi_type(tags: Column, is_node: Column) -> Column:
    get = lambda k: tag(tags, k)
    # one lookup a key gives the place in the rule list, the least place wins
    keys = dict.fromkeys(k for k, _, _ in POI_RULES)
    places = [lookup({v: i for i, (key, v, _) in enumerate(POI_RULES) if key == k}, get(k)) for k in keys]
    ranked = lookup({i: t for i, (_, _, t) in enumerate(POI_RULES)}, F.least(*places))
    hits = [
        (_is(get("man_made"), "tower") & (_is(get("tower:type"), "observation") | _is(get("leisure"), "bird_hide")), F.lit(0x0F)),
        (_is(get("amenity"), "charging_station") & _is(get("bicycle"), "yes"), F.lit(0x28)), (_is(get("aeroway"), "aerodrome") & is_node, F.lit(0x27)),
        (lookup(LIFTS, get("aerialway")).isNotNull(), lookup(LIFTS, get("aerialway"))), (get("historic").isNotNull() & ~_is(get("historic"), *HISTORIC_SKIP), F.lit(0x48)),
    ]
    # places of worship and boat facilities never fall through to the other rules
    return (F.when(_is(get("amenity"), "place_of_worship"), lookup(RELIGION, get("religion")))
            .when(_is(get("seamark:type"), "small_craft_facility"), lookup(SMALL_CRAFT, get("seamark:small_craft_facility:category"))).otherwise(F.coalesce(ranked, first_match(hits))))


def poi_attributes(tags: Column) -> Column:
    """``NNvalue|NNvalue`` by code."""
    line = lambda a, b: F.array_join(F.array_compact(F.array(first_tag(tags, a), first_tag(tags, b))), " ")
    address = F.array_join(F.filter(F.array(line("addr:street", "addr:housenumber"), line("addr:postcode", "addr:city")), lambda x: x != ""), "\n")
    parts = [F.when(address != "", F.concat(F.lit("00"), address))]
    for code, keys in POI_ATTRIBUTES:
        value = first_tag(tags, *keys)
        value = F.replace(F.replace(value, F.lit("; "), F.lit("\n")), F.lit(";"), F.lit("\n")) if code == "03" else value
        parts.append(F.concat(F.lit(code), value))
    return F.array_join(F.array_compact(F.array(*parts)), "|")


def _area(array: str, cls: int | None) -> Column:
    return F.struct(F.lit(array).alias("array"), F.lit(cls).cast("int").alias("class"))


def area_class(tags: Column) -> Column:
    """``struct<array, class>`` of an area; land use wins over natural, rivers are left to the lines."""
    get = lambda k: tag(tags, k)
    table = lambda key, rules: first_match([(_is(get(key), *values), _area(array, cls)) for values, array, cls in rules])
    ground = F.coalesce(table("landuse", LANDUSE), table("natural", NATURAL))
    others = F.coalesce(F.when(_is(get("leisure"), *LEISURE_AREA), _area("c5", 5)), table("man_made", MAN_MADE_AREA), F.when(_is(get("waterway"), "dock"), _area(WATER, None)))
    return F.when(ground.isNotNull(), F.when(~((ground.getField("array") == WATER) & _is(get("water"), "river")), ground)).otherwise(others)


def cover_class(tag_list: Column) -> Column:
    """Land cover of the first tag that has one; ``tag_list``: ``array<struct<k, v>>`` in file order."""
    one = lambda t: first_match([((t.getField("k") == key) & t.getField("v").isin(*values), F.lit(name)) for key, values, name in COVER])
    return F.get(F.filter(F.transform(tag_list, one), lambda c: c.isNotNull()), 0)


def is_address(tags: Column) -> Column:
    return tag(tags, "addr:housenumber").isNotNull() & (tag(tags, "addr:street").isNotNull() | tag(tags, "addr:place").isNotNull())


def is_place(tags: Column) -> Column:
    return tag(tags, "name").isNotNull() & _is(tag(tags, "place"), *PLACES)


def is_multipolygon(tags: Column) -> Column:
    return _is(tag(tags, "type"), "multipolygon", "boundary")


def region_level(tags: Column) -> Column:
    level = F.trim(tag(tags, "admin_level")).try_cast("int")
    return F.when(is_multipolygon(tags) & _is(tag(tags, "boundary"), "administrative") & tag(tags, "name").isNotNull() & level.isin(*ADMIN_LEVELS), level)


def keeps_area(tags: Column) -> Column:
    """An object with one of the area keys that is no coastline and isn't declared to be no area."""
    return F.arrays_overlap(F.map_keys(tags), F.array(*[F.lit(k) for k in AREA_KEYS])) & ~_is(tag(tags, "area"), "no") & ~is_coastline(tags)


def is_coastline(tags: Column) -> Column:
    """Coast ways are chained instead of being areas."""
    return _is(tag(tags, "natural"), "coastline")


def draw_order(cls: Column) -> Column:
    return lookup({c: i for i, c in enumerate(CLASS_ORDER)}, cls)
