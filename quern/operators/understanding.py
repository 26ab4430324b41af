"""Query understanding: intents, retrieval parameters, addresses, commands, semantic groups and query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import CIDR, IP_RANGE, IPV4, LEFT, RIGHT, contains_any, first_of, held, staged, trimmed, words_of


def query_intent(queries: DataFrame) -> DataFrame:
    """Intent of every row of ``queries`` (query_id, query, history array or null).

    Adds intent, confidence, reasons, sub_intents, has_error, has_command, has_parameter and complexity. Each intent scores 0.3 a
    keyword and 0.5 a pattern, times its weight; the intent of the last two turns of history adds 0.2 if it has scored. Intents
    at second and third place above 0.6 of the best are sub-intents. Nothing scored is "general" with confidence 0.5.
    """
    if "history" not in queries.columns:
        queries = queries.withColumn("history", F.array().cast("array<string>"))
    turns = F.coalesce("history", F.array().cast("array<string>"))
    recent = F.lower(F.array_join(F.slice(turns, F.greatest(F.size(turns) - 1, F.lit(1)), F.lit(2)), " "))
    read = staged(queries, _q=F.lower(F.coalesce("query", F.lit(""))), _recent=recent)
    q = F.col("_q")
    context = first_of([(name, F.col("_recent").rlike(pattern)) for name, pattern in v.CONTEXT_INTENTS], None)
    counted = {"_context": context}
    for place, (_, _, keywords, patterns) in enumerate(v.INTENTS):
        counted[f"_words{place}"] = held(q, keywords)
        counted[f"_hits{place}"] = sum((q.rlike(p).cast("int") for p in patterns[1:]), q.rlike(patterns[0]).cast("int"))
    counts = staged(read, **counted)
    scored = []
    for place, (name, weight, _, _) in enumerate(v.INTENTS):
        words, hits = F.col(f"_words{place}"), F.col(f"_hits{place}")
        own = (F.size(words) * 0.3 + hits * 0.5) * weight
        backed = (own > 0) & (F.col("_context") == name)
        reasons = F.filter(F.array(F.when(F.size(words) > 0, F.concat(F.lit("keywords: "), F.array_join(words, ", "))), F.when(hits > 0, F.concat(F.lit("patterns: "), hits.cast("string"))), F.when(backed, F.lit("context"))), lambda r: r.isNotNull())
        total = F.round(own + F.when(backed, 0.2).otherwise(0.0), 9)
        scored.append(F.struct((-total).alias("down"), F.lit(place).alias("place"), F.lit(name).alias("name"), total.alias("score"), reasons.alias("reasons")))
    ranked = F.array_sort(F.filter(F.array(*scored), lambda s: s["score"] > 0))
    top = F.col("ranked")[0]
    text = F.coalesce("query", F.lit(""))
    points = (F.length(text) > 50).cast("int") + (F.size(F.split(text, r"\s+")) > 10).cast("int") + text.rlike(v.CONDITION_PATTERN).cast("int") + text.rlike(v.PARAMETER_PATTERN).cast("int")
    some = F.size("ranked") > 0
    return (
        staged(counts, ranked=ranked)
        .withColumns(
            {
                "intent": F.when(some, top["name"]).otherwise("general"),
                "confidence": F.when(some, F.least(F.lit(1.0), top["score"] / F.greatest(top["score"], F.lit(1.0)))).otherwise(0.5),
                "reasons": F.when(some, top["reasons"]).otherwise(F.array(F.lit("no intent recognised"))),
                "sub_intents": F.transform(F.filter(F.slice("ranked", 2, 2), lambda s: s["score"] > F.col("ranked")[0]["score"] * 0.6), lambda s: s["name"]),
                "has_error": q.rlike(v.ERROR_PATTERN),
                "has_command": q.rlike(v.COMMAND_HINT_PATTERN),
                "has_parameter": text.rlike(v.PARAMETER_PATTERN),
                "complexity": F.when(points >= 3, "complex").when(points >= 1, "medium").otherwise("simple"),
            }
        )
        .drop("ranked", "_q", "_recent", *counted)
    )


def retrieval_parameters(intents: DataFrame) -> DataFrame:
    """Adds retrieve_limit, rerank_candidates and min_score by intent; a doubtful intent lowers the least score by 0.05, a
    confident one raises it."""
    table = F.create_map(*(x for name, row in v.RETRIEVAL.items() for x in (F.lit(name), F.struct(*(F.lit(value).alias(key) for key, value in zip(("limit", "candidates", "least"), row))))))
    own = table[F.col("intent")]
    shift = F.when(F.col("confidence") < 0.5, -0.05).when(F.col("confidence") > 0.8, 0.05).otherwise(0.0)
    return intents.withColumns({"retrieve_limit": own["limit"], "rerank_candidates": own["candidates"], "min_score": F.round(own["least"] + shift, 4)})


def intent_accuracy(intents: DataFrame, bar: float = 0.8) -> DataFrame:
    """category (null: all), n, hits, accuracy and passed of rows (category, intent, expected_intent)."""
    hit = (F.col("intent") == F.col("expected_intent")).cast("double")
    return intents.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("long")).alias("hits"), F.round(F.avg(hit), 4).alias("accuracy")).withColumn("passed", F.col("accuracy") >= bar)


def network_addresses(text: Column) -> Column:
    """Networks, single addresses that are not a network's base, and ranges, each once, in that order."""
    find = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    as_struct = lambda kind: lambda a: F.struct(a.alias("address"), F.lit(kind).alias("type"), (F.regexp_extract(a, r"/(\d+)$", 1) if kind == "cidr" else F.lit(None).cast("string")).alias("mask"))
    single = F.filter(find(IPV4), lambda a: ~F.contains(text, F.concat(a, F.lit("/"))))
    return F.concat(F.transform(find(CIDR), as_struct("cidr")), F.transform(single, as_struct("ipv4")), F.transform(find(IP_RANGE), as_struct("range")))


def command_list(text: Column) -> Column:
    """Command words in text order, with the query's action, target and parameters."""
    q = F.lower(text)
    action = first_of([(name, contains_any(q, words)) for name, words in v.ACTIONS], "show")
    target = first_of([(name, contains_any(q, words)) for name, words in v.TARGETS], "general")
    parameters = F.array_distinct(F.concat(F.transform(network_addresses(text), lambda a: a["address"]), F.regexp_extract_all(text, F.lit(LEFT + r"\d+" + RIGHT), F.lit(0))))
    return F.transform(words_of(text, v.COMMANDS), lambda c: F.struct(c.alias("command"), parameters.alias("parameters"), action.alias("action"), target.alias("target")))


def semantic_groups(text: Column) -> Column:
    """Groups with their distinct words; confidence is the share of the query's words that are such words."""
    q = F.lower(text)
    n = F.size(F.split(q, r"\s+"))
    groups = [F.when(F.size(words_of(q, words)) > 0, F.struct(F.lit(name).alias("type"), F.array_distinct(words_of(q, words)).alias("elements"), (F.size(words_of(q, words)) / n).alias("confidence"))) for name, words in v.SEMANTIC_GROUPS.items()]
    return F.filter(F.array(*groups), lambda g: g.isNotNull())


def basic_keywords(text: Column) -> Column:
    """Acronyms, proper nouns, mixed-case terms, then all words but stop words; lower case, each once."""
    plain = trimmed(F.regexp_replace(F.regexp_replace(text, "[，。！？；：\"'（）【】《》]", " "), r"\s+", " "))
    find = lambda p: F.regexp_extract_all(plain, F.lit(LEFT + p + RIGHT), F.lit(0))
    words = F.split(F.regexp_replace(F.lower(plain), r"[^一-龥a-zA-Z0-9\s]", " "), r"\s+")
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*v.STOP_WORDS))
    named = F.concat(find("[A-Z]{2,}"), find("[A-Z][a-z]+"), find(r"(?:[A-Z]+[a-z]*|[a-z]+[A-Z]+)\d*"))
    return F.array_distinct(F.concat(F.transform(named, F.lower), kept))


def query_keywords(queries: DataFrame) -> DataFrame:
    """Adds addresses, commands, groups, keywords and coarse_intent to ``queries`` (query)."""
    text = F.coalesce("query", F.lit(""))
    q = F.lower(text)
    found = queries.withColumns({"addresses": network_addresses(text), "commands": command_list(text), "groups": semantic_groups(text)})
    kinds = F.transform("groups", lambda g: g["type"])
    some_command = F.size("commands") > 0
    intent = first_of(
        [
            ("network_config", (F.size("addresses") > 0) & some_command),
            ("command_reference", some_command | contains_any(q, ("命令", "command"))),
            ("troubleshooting", contains_any(q, ("问题", "故障", "error", "失败"))),
            ("network_config", F.array_contains(kinds, "network_config") | F.array_contains(kinds, "access_control")),
        ],
        "general",
    )
    every = F.array_distinct(F.concat(basic_keywords(text), F.transform("addresses", lambda a: a["address"]), F.transform("commands", lambda c: c["command"]), F.flatten(F.transform("groups", lambda g: g["elements"]))))
    return found.withColumns({"keywords": every, "coarse_intent": intent})


def domain_terms(queries: DataFrame) -> DataFrame:
    """Adds tech_terms, vendors, config_terms, search_keywords, domain_intent and the has_ flags to ``queries`` (query)."""
    text = F.coalesce("query", F.lit(""))
    q = F.lower(text)
    acl = F.when(contains_any(q, ("acl", "access control list")), F.array(F.lit("acl"), F.lit("access control list"))).otherwise(F.array().cast("array<string>"))
    tech = F.array_distinct(F.concat(*(held(q, words) for words in v.DOMAIN_TERMS.values()), acl))
    cjk = F.filter(F.regexp_extract_all(text, F.lit("[一-龥]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(*v.DOMAIN_STOP_WORDS))
    latin = F.filter(F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    out = queries.withColumns({"tech_terms": tech, "vendors": held(q, v.VENDORS), "config_terms": held(q, v.CONFIG_TERMS)})
    out = out.withColumn("search_keywords", F.array_distinct(F.concat("tech_terms", "vendors", "config_terms", cjk, latin)))
    out = out.withColumns({name: F.array_contains("tech_terms", a) | F.array_contains("tech_terms", b) for name, (a, b) in v.DOMAIN_FLAGS})
    some = lambda c: F.size(c) > 0
    return out.withColumn("domain_intent", first_of([("network_config", some("tech_terms") & some("config_terms")), ("tech_reference", some("tech_terms")), ("vendor_specific", some("vendors"))], "general"))


def expanded_query(queries: DataFrame) -> DataFrame:
    """Adds enhanced (domain words, general words and the query's own keywords) and routed (whether the domain expansion was used).

    A query with routing words gets the words of each recognised technology; any other gets its addresses, commands with their
    action, group words and keywords.
    """
    found = domain_terms(query_keywords(queries))
    none = F.array().cast("array<string>")
    words = lambda condition, adds: F.when(condition, F.array(*map(F.lit, adds))).otherwise(none)
    domain = F.array_distinct(
        F.concat(
            *(words(F.col(flag), adds) for flag, adds in v.DOMAIN_ADDS),
            words(F.array_contains("tech_terms", "acl") | F.array_contains("tech_terms", "access control list"), v.ACL_ADDS),
            words(F.col("has_qos") | F.col("has_pfc") | F.col("has_ecn") | F.col("has_roce"), v.QOS_ADDS),
            words(F.array_contains("vendors", "nvidia"), v.VENDOR_ADDS),
            F.array(*map(F.lit, v.ALWAYS_ADDS)),
            words(F.col("domain_intent") == "network_config", v.CONFIG_ADDS),
            F.when(F.size("search_keywords") > 0, F.col("search_keywords")).otherwise(F.col("keywords")),
        )
    )
    general = F.concat(F.transform("addresses", lambda a: a["address"]), F.transform("commands", lambda c: F.concat_ws(" ", c["command"], c["action"])), F.flatten(F.transform("groups", lambda g: g["elements"])), F.col("keywords"))
    routed = contains_any(F.lower(F.coalesce("query", F.lit(""))), v.ROUTING_WORDS)
    return found.withColumns({"routed": routed, "enhanced": F.array_join(F.when(routed, domain).otherwise(general), " ")})

