"""Entities, edges and bulk lookups extracted from chunks (chunk_order, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, first_of, trimmed

# Forms of serials, hosts, uplink switches and addresses.
SERIAL = r"(?<![A-Za-z0-9_])(?i:[A-Z]{3}[A-Z0-9]{8,12})(?![A-Za-z0-9_])"
HOST = r"MDC-[A-Z0-9-]+-GPU-\d+"
UPLINK = r"MDC-[A-Z0-9-]+-IBLF-\d+"
ADDRESS = r"\d+\.\d+\.\d+\.\d+"
FIELD = r"[^,\r\n]+"

# Layer, pattern, and which groups are source device and port, destination device and port.
EDGES = (
    ("server-iblf", rf"(?i)({HOST}),(\d+)[^,\r\n]*,[^,\r\n]*,[^,\r\n]*,[^,\r\n]*,[^,\r\n]*,({UPLINK}),(\d+/\d+)", (1, 2, 3, 4)),
    ("iblf-spine", rf"(?i)({UPLINK}),({FIELD}),(POD\d+-SPINE\d+),({FIELD})", (1, 2, 3, 4)),
    ("spine-core", rf"(?i)(POD\d+-SPINE\d+),({FIELD}),(CORE\d+),({FIELD})", (1, 2, 3, 4)),
    ("spine-core", rf"(?i)(CORE\d+),({FIELD}),(POD\d+-SPINE\d+),({FIELD})", (3, 4, 1, 2)),
    ("core-edge", rf"(?i)(CORE\d+),({FIELD}),(EDGE\d+|HSS-LEAF\d+|STL-LEAF\d+),({FIELD})", (1, 2, 3, 4)),
    ("oob", rf"(?i)(OOB-SPINE\d+),({FIELD}),(OOB-LEAF\d+|EDGE\d+),({FIELD})", (1, 2, 3, 4)),
)
# Address prefixes of the two management networks.
OUT_OF_BAND, IN_BAND = ("10.240.8.", "10.240.9."), ("10.240.0.", "10.240.1.")


def serials(text: Column) -> Column:
    """Distinct serial-like words of a text, in upper case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SERIAL), F.lit(0)), F.upper))


def lookup_list(lists: DataFrame) -> DataFrame:
    """position and sn of every entry of pasted lists (raw): split at line feeds, commas and spaces, upper case, blanks dropped."""
    parts = lists.select(F.posexplode(F.split("raw", r"[\n,\s]+")).alias("position", "sn"))
    return parts.withColumn("sn", F.upper(trimmed(F.col("sn")))).filter("sn <> ''")


def last_address(text: Column, prefixes: tuple[str, ...]) -> Column:
    """The last address of a text that starts with one of the prefixes, else an empty text."""
    fits = lambda a: any_of([a.startswith(p) for p in prefixes])
    return F.coalesce(F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), fits), F.lit(-1)), F.lit(""))


def line_serials(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """sn, chunk_order, line, rest (what follows the serial on its line) and the chunk's last_out and last_in, the last addresses
    of the two management networks, for every serial of ``wanted`` (sn, upper case) on every line that names a host.

    Serials may have any shape: they are looked for among runs of letters, digits and underscores and among what stands between
    white space and commas.
    """
    dated = chunks.select("chunk_order", "content", last_address(F.col("content"), OUT_OF_BAND).alias("last_out"), last_address(F.col("content"), IN_BAND).alias("last_in"))
    lines = dated.select("chunk_order", "last_out", "last_in", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("line", "value"))
    words = F.concat(F.regexp_extract_all(F.upper("value"), F.lit("[A-Z0-9_]+"), F.lit(0)), F.split(F.upper("value"), r"[\s,]+"))
    named = lines.filter(F.upper("value").rlike(HOST)).withColumn("sn", F.explode(F.array_distinct(words)))
    found = named.join(wanted.select("sn").distinct(), "sn", "left_semi")
    return found.withColumn("rest", F.substring(F.col("value"), F.expr("instr(upper(value), sn)"), F.length("value"))).drop("value")


def serial_hosts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """sn and hostname of wanted serials: the first host after the serial on a line, of the first chunk that has one."""
    found = line_serials(chunks, wanted).withColumn("hostname", F.regexp_extract("rest", f"(?i)({HOST})", 1)).filter("hostname <> ''")
    return found.groupBy("sn").agg(F.min_by("hostname", F.struct("chunk_order", "line")).alias("hostname"))


def host_uplinks(chunks: DataFrame) -> DataFrame:
    """hostname and iblf of every line that names a host and, after it, an uplink switch."""
    lines = chunks.select(F.explode(F.split("content", r"\r\n|\r|\n")).alias("value")).filter(F.contains(F.upper("value"), F.lit("IBLF")))
    pattern = rf"(?i)({HOST}).*?({UPLINK})"
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("hostname"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("iblf"))
    return lines.select(F.explode(pairs).alias("pair")).select("pair.hostname", "pair.iblf").distinct()


def switch_lookup(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """position, sn, hostname and iblfs (sorted; null hostname: not found) of every row of ``wanted`` (position, sn).

    Repeated serials keep their rows. Serials of any shape are compared as whole words, not as parts of longer ones.
    """
    switches = host_uplinks(chunks).groupBy("hostname").agg(F.array_sort(F.collect_set("iblf")).alias("iblfs"))
    found = wanted.join(serial_hosts(chunks, wanted), "sn", "left").join(switches, "hostname", "left")
    return found.select("position", "sn", "hostname", F.when(F.col("hostname").isNotNull(), F.coalesce("iblfs", F.array().cast("array<string>"))).alias("iblfs"))


def switch_groups(found: DataFrame) -> DataFrame:
    """iblfs, n and servers: found rows of a switch lookup grouped by equal switch sets, largest first."""
    key = F.array_join("iblfs", "|")
    groups = found.filter("hostname IS NOT NULL").groupBy(key.alias("key")).agg(F.first("iblfs").alias("iblfs"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("position", "sn", "hostname"))).alias("servers"))
    return groups.orderBy(F.desc("n"), "key").drop("key")


def lookup_summary(found: DataFrame) -> DataFrame:
    """total, found, not_found and groups of a lookup's rows."""
    sets = F.count_distinct(F.when(F.col("hostname").isNotNull(), F.array_join("iblfs", "|"))) if "iblfs" in found.columns else F.lit(None).cast("long")
    return found.agg(F.count(F.lit(1)).alias("total"), F.count("hostname").alias("found"), F.count_if(F.col("hostname").isNull()).alias("not_found"), sets.alias("groups"))


def address_lookup(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """sn, hostname, outband and inband of every distinct serial of ``wanted`` (null hostname: not found).

    A full line (host, alias, out-of-band and in-band address) gives all; else the host alone, with the last address of each
    management network in the chunk. The first chunk that has the serial with a host decides.
    """
    full = rf"(?i)({HOST})[^,]*,([^,]*),({ADDRESS}),({ADDRESS})"
    places = line_serials(chunks, wanted).withColumn("hostname", F.regexp_extract("rest", f"(?i)({HOST})", 1)).filter("hostname <> ''")
    with_full = places.withColumns({"whole": F.col("rest").rlike(full), "out_full": F.regexp_extract("rest", full, 3), "in_full": F.regexp_extract("rest", full, 4)})
    # inside the deciding chunk a full line comes first
    order = Window.partitionBy("sn").orderBy("chunk_order", F.desc("whole"), "line")
    best = with_full.withColumn("turn", F.row_number().over(order)).filter("turn = 1")
    resolved = best.select("sn", "hostname", F.when(F.col("whole"), F.col("out_full")).otherwise(F.col("last_out")).alias("outband"), F.when(F.col("whole"), F.col("in_full")).otherwise(F.col("last_in")).alias("inband"))
    return wanted.select("sn").distinct().join(resolved, "sn", "left")


def topology_edges(chunks: DataFrame) -> DataFrame:
    """layer, source_device, source_port, dest_device and dest_port, each link once (the first layer and chunk that name it)."""
    found = None
    for place, (layer, pattern, (a, b, c, d)) in enumerate(EDGES):
        groups = [F.regexp_extract_all("content", F.lit(pattern), F.lit(g)) for g in (a, b, c, d)]
        zipped = F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("a", "b", "c", "d"))))
        edges = chunks.select("chunk_order", F.lit(place).alias("place"), F.lit(layer).alias("layer"), F.posexplode(zipped).alias("spot", "e"))
        edges = edges.select("chunk_order", "place", "spot", "layer", F.col("e.a").alias("source_device"), trimmed(F.col("e.b")).alias("source_port"), F.col("e.c").alias("dest_device"), trimmed(F.col("e.d")).alias("dest_port"))
        found = edges if found is None else found.unionByName(edges)
    link = ["source_device", "source_port", "dest_device", "dest_port"]
    return found.groupBy(*link).agg(F.min_by("layer", F.struct("chunk_order", "place", "spot")).alias("layer"), F.min(F.struct("chunk_order", "place", "spot")).alias("first")).select("layer", *link, "first")


def topology(chunks: DataFrame, cap: int = 100) -> DataFrame:
    """The first ``cap`` links in the order found."""
    return topology_edges(chunks).orderBy("first", "source_device", "source_port").drop("first").limit(cap)


def topology_devices(edges: DataFrame) -> DataFrame:
    """tier, devices (sorted) and n of all devices on links."""
    devices = edges.select(F.explode(F.array("source_device", "dest_device")).alias("device"))
    return devices.groupBy(device_tier(F.col("device")).alias("tier")).agg(F.array_sort(F.collect_set("device")).alias("devices"), F.count_distinct("device").alias("n"))


def pod_of(hostname: Column) -> Column:
    """POD and two digits, 01 if the name has none."""
    number = F.regexp_extract(hostname, r"(?i)POD(\d+)", 1)
    return F.concat(F.lit("POD"), F.when(number == "", F.lit("01")).when(F.length(number) >= 2, number).otherwise(F.lpad(number, 2, "0")))


def device_tier(name: Column) -> Column:
    """Tier of a device by ordered rules on its name."""
    has = lambda w: F.contains(name, F.lit(w))
    rules = [
        ("server", has("GPU") | has("SERVER") | name.startswith("MDC-") & ~has("IBLF")),
        ("iblf", has("IBLF")),
        ("spine", has("SPINE") & ~has("OOB")),
        ("core", has("CORE")),
        ("edge", has("EDGE") & ~has("OOB")),
        ("leaf", has("LEAF") & ~has("OOB")),
        ("oob", has("OOB")),
    ]
    return first_of(rules, "server")
