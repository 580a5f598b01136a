"""Column expressions of the payment domain; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrine.config import CHANNELS, CITIES, EARTH_KM, TIERS


def java_round(x: Column, digits: int) -> Column:
    """Half up towards plus infinity, unlike SQL's round."""
    p = float(10**digits)
    return F.floor(x * p + 0.5) / p


def merchant_category(merchant: Column) -> Column:
    """The second token of ``m_CAT_nnnn``; UNKNOWN with fewer than three tokens, trailing empty ones not counted."""
    parts = F.split(F.regexp_replace(merchant, "_+$", ""), "_")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise("UNKNOWN")


def merchant_risk_tier(df: DataFrame, category: str = "category") -> DataFrame:
    """Adds ``tier`` by a join with the table of tiers, a handful of rows fixed in the configuration."""
    tiers = df.sparkSession.createDataFrame(list(TIERS.items()), f"{category} string, tier int")
    return df.join(F.broadcast(tiers), category, "left").withColumn("tier", F.coalesce("tier", F.lit(0)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def shadow_sample(txn_id: Column, rate: float) -> Column:
    """Whether an id belongs to the deterministic sample: a 32-bit hash of its characters, spread and scaled."""
    if rate <= 0 or rate >= 1:
        return txn_id.isNotNull() if rate >= 1 else F.lit(False)
    mask = F.lit(0xFFFFFFFF).cast("long")
    chars = F.filter(F.split(txn_id, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: (acc * 31 + F.ascii(c)).bitwiseAND(mask))
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    low, high = F.lit(0xCA6B).cast("long"), F.lit(0x85EB).cast("long")  # the multiplier in halves, so nothing overflows
    h = (h * low + F.shiftleft((h * high).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)).bitwiseAND(mask)
    # the shift is an unsigned one
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13)).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    return F.coalesce(h / F.lit(2147483647.0) < rate, F.lit(False))


def channel_code(channel: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(channel == kv[0], kv[1]), CHANNELS.items(), F.when(F.lit(False), 0))


def rule_families(fired: Column) -> Column:
    """Ordered families of the fired rules."""
    has = lambda *codes: F.arrays_overlap(fired, F.array(*map(F.lit, codes)))
    return F.array_compact(F.array(
        F.when(has("RING_SUSPECT", "PASS_THROUGH"), "RING"), F.when(has("GEO_IMPOSSIBLE"), "GEO"),
        F.when(F.exists(fired, lambda r: r.startswith("VELOCITY")), "VELOCITY"), F.when(has("HARD_BLOCK_MERCHANT", "AMOUNT_CAP"), "POLICY"),
    ))


def primary_pattern(fired: Column) -> Column:
    # Rule to pattern, in order of precedence.
    order = (("RING_SUSPECT", "RING"), ("PASS_THROUGH", "RING"), ("GEO_IMPOSSIBLE", "GEO"), ("VELOCITY_1M", "VELOCITY"), ("HARD_BLOCK_MERCHANT", "POLICY"))
    return F.coalesce(*[F.when(F.array_contains(fired, r), p) for r, p in order])


def nearest_city(lat: Column, lon: Column, within_km: float = 30.0) -> Column:
    """Name of the nearest listed city closer than ``within_km``, else null."""
    all_ = F.array(*[F.struct(haversine_km(lat, lon, F.lit(a), F.lit(b)).alias("km"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, a, b) in enumerate(CITIES)])
    best = F.array_min(all_)
    return F.when(best["km"] < within_km, best["name"])


def nearest_city_by_degrees(lat: Column, lon: Column, within: float = 1.0) -> Column:
    """Name of the listed city nearest in degrees, if they are less than ``within`` apart, else null."""
    all_ = F.array(*[F.struct((F.pow(lat - a, 2) + F.pow(lon - b, 2)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, a, b) in enumerate(CITIES)])
    best = F.array_min(all_)
    return F.when(best["d"] < within**2, best["name"])


# Texts by rule.
HYPOTHESES = {
    "VELOCITY_1M": "An automated burst or card testing on this account",
    "VELOCITY_5M": "Sustained automated activity on this account",
    "VELOCITY_1H": "A script running against this account over an hour",
    "GEO_IMPOSSIBLE": "A cloned card used in two places at once",
    "RING_SUSPECT": "Layering: money moving in a circle between accounts",
    "PASS_THROUGH": "Layering: money forwarded onwards soon after it arrived",
    "HARD_BLOCK_MERCHANT": "Payment to a sanctioned merchant, a policy breach rather than a pattern",
    "AMOUNT_CAP": "A transaction above the absolute policy cap",
}


def triage_hypotheses(fired: Column, default: str = "No rule fired; the model score alone raised it") -> Column:
    known = F.create_map(*[F.lit(x) for kv in HYPOTHESES.items() for x in kv])
    texts = F.filter(F.transform(fired, lambda r: F.try_element_at(known, r)), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(default)))


# The questions.
def suggested_questions(fired: Column) -> Column:
    always = F.array(F.lit("Why was this flagged?"), F.lit("Is this normal for the account?"), F.lit("What evidence would change the verdict?"))
    has = lambda *c: F.arrays_overlap(fired, F.array(*map(F.lit, c)))
    more = F.array_compact(F.array(
        F.when(F.exists(fired, lambda r: r.startswith("VELOCITY_")), "Could this be a genuine shopping spree?"),
        F.when(has("GEO_IMPOSSIBLE"), "Could this be a real trip?"),
        F.when(has("RING_SUSPECT", "PASS_THROUGH"), "Where did the money come from, and where did it go?"),
        F.when(has("HARD_BLOCK_MERCHANT"), "Why is this merchant blocked outright?"),
    ))
    return F.concat(always, more)


# Words that ask for a kind of evidence.
ROUTES = (
    ("get_user_history", r"\b(normal|usual|unusual|typical|typically|history|previous|previously|before|spree|genuine|legit\w*)\b"),
    ("get_graph_neighborhood", r"\b(where did|where does|where is|come from|go to|went|who|counterpart\w*|rings?|chain|layering|forward\w*|neighbo\w*|network|cycle)\b"),
    ("find_similar_cases", r"\b(similar|precedent\w*|other cases|resolved|how did .* end)\b"),
)


def route_text(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), name) for name, p in ROUTES]))


def normalize_question(text: Column) -> Column:
    """Case, runs of white space and trailing question marks do not matter."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), r"\?+$", "")


def question_key(case_id: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", case_id, normalize_question(text), F.lit("[]")), 256)


def summary_text(summary: Column, fired: Column, fraud_type: Column) -> Column:
    codes = F.array_join(F.coalesce(fired, F.array().cast("array<string>")), ", ")
    return F.trim(F.concat_ws(" ", F.nullif(summary, F.lit("")), F.when(codes != "", F.concat(F.lit("signals: "), codes)), F.concat(F.lit("type: "), F.coalesce(fraud_type, F.lit("UNKNOWN")))))


def latency_ms(ts_ms: Column, decided_ms: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), decided_ms - ts_ms), F.lit(0)).cast("long")


def decimal_places(value: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(F.format_string("%.10f", value), r"\.(\d*)", 1), "0+$", ""))


def number_matches(value: Column, candidate: Column, places: Column | None = None) -> Column:
    """Whether a quoted number is a fair reading of one in the evidence: equal, within 1 %, rounded or truncated. ``places`` are those of ``value``, if known."""
    places = decimal_places(value) if places is None else places
    gap = F.abs(value - candidate)
    near = gap <= F.greatest(F.abs(value), F.abs(candidate)) * 0.01
    return near | (gap <= 0.5 * F.pow(F.lit(10.0), -places) + 1e-9) | ((places == 0) & (value == F.when(candidate < 0, F.ceil(candidate)).otherwise(F.floor(candidate))))


# What is no quantity.
def extract_quantities(text: Column) -> Column:
    """``array<struct<value double, is_percent boolean>>``: numbers that assert a quantity, not times, ids or markers."""
    t = F.translate(text, "\u2212\u2010\u2011\u2012\u2013\ufe63\uff0d", "-------")
    t = F.regexp_replace(t, "(?<=\\d)[\u202f\u00a0\u2009](?=\\d{3}(?!\\d))", "")
    t = F.regexp_replace(t, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?", " ")
    t = F.regexp_replace(t, "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", " ")
    t = F.regexp_replace(t, r"\[\s*\d+(\s*,\s*\d+)*\s*\]", " ")
    found = F.regexp_extract_all(t, F.lit(r"((-?\d{1,3}(,\d{3})+(\.\d+)?|-?\d+(\.\d+)?)%?)"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_replace(x, "[,%]", "").cast("double").alias("value"), x.endswith("%").alias("is_percent")))


def _json_values(payload: Column) -> Column:
    """All values of a JSON text, from the whole of it down to each member, as variants.

    Level by level, in as many rounds as the text has opening brackets at most; a level without members costs nothing.
    """
    none = F.array().cast("array<variant>")

    def members(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        inner = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(kind.startswith("OBJECT"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))
        return F.coalesce(inner, none)

    opened = F.length(payload) - F.length(F.translate(payload, "[{", ""))
    zero = F.struct(F.array(F.try_parse_json(payload)).cast("array<variant>").alias("level"), none.alias("seen"))
    step = lambda acc, _: F.struct(F.flatten(F.transform(acc["level"], members)).alias("level"), F.concat(acc["seen"], acc["level"]).alias("seen"))
    return F.aggregate(F.sequence(F.lit(0), opened), zero, step, lambda acc: F.concat(acc["seen"], acc["level"]))


def flatten_numbers(payload: Column) -> Column:
    """Every number of a JSON text by size, those inside strings and keys too, and for arrays how many members and different members they have.

    Members are told apart as values, 1 and 1.0 and true being one, unless some are lists or objects.
    """
    none = F.array().cast("array<double>")
    quoted = lambda t: F.transform(extract_quantities(t), lambda q: q["value"])
    is_number = lambda kind: kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")

    def same(y: Column) -> Column:
        kind = F.schema_of_variant(y)
        return F.when(is_number(kind) | (kind == "BOOLEAN"), F.concat(F.lit("n"), F.try_variant_get(y, "$", "double").cast("string"))).otherwise(F.concat(kind, F.coalesce(F.try_variant_get(y, "$", "string"), F.lit(""))))

    def numbers(v: Column) -> Column:
        kind, items = F.schema_of_variant(v), F.try_variant_get(v, "$", "array<variant>")
        nested = F.exists(items, lambda y: F.schema_of_variant(y).startswith("ARRAY") | F.schema_of_variant(y).startswith("OBJECT"))
        sizes = F.array_compact(F.array(F.size(items).cast("double"), F.when(~nested, F.size(F.array_distinct(F.transform(items, same))).cast("double"))))
        keys = F.flatten(F.transform(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), quoted))
        found = F.when(is_number(kind), F.array(F.try_variant_get(v, "$", "double"))).when(kind.startswith("ARRAY"), sizes).when(kind.startswith("OBJECT"), keys)
        return F.coalesce(found.when(kind == "STRING", quoted(F.try_variant_get(v, "$", "string"))), none)

    every = F.flatten(F.transform(_json_values(payload), numbers))
    sized = F.transform(F.filter(every, lambda x: F.abs(x) < 1e308), lambda x: F.abs(x))
    # what is no JSON counts as one string
    plain = F.array_sort(F.array_distinct(F.transform(quoted(payload), lambda x: F.abs(x))))
    return F.when(payload.isNull(), none).when(F.try_parse_json(payload).isNull(), plain).otherwise(F.array_sort(F.array_distinct(sized)))
