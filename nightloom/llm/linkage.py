"""Records of sources without common keys, paired by a cascade of exact rules.

Each pass joins what is left on a weaker combination of attributes and
anti-joins the partners it resolves. A rule's confidence is its precision on
labelled pairs, smoothed towards a prior.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.llm.components import tidy_id
from nightloom.llm.places import map_places
from nightloom.session import cut

# Words for one shape.
SHAPES = {
    "plus sign": "cross", "v shape": "chevron", "boomerang": "chevron", "point of light": "light", "glow": "light", "delta": "triangle", "wedge": "triangle",
    "kite": "diamond", "rhombus": "diamond", "egg": "oval", "ellipse": "oval", "bell": "cone", "funnel": "cone", "flame": "fireball", "burning ball": "fireball",
    "cluster": "formation", "string of lights": "formation", "disc": "disk", "plate": "disk", "saucer": "disk", "tube": "cigar", "rod": "cigar", "cylinder": "cigar",
    "ball": "sphere", "orb": "sphere", "globe": "sphere",
}

# Colour words, number words and kinds of streets with their short forms.
COLOURS = "amber black blue bronze brown copper crimson emerald gold golden green gray grey indigo ivory lilac magenta orange pearl pink purple red scarlet silver teal turquoise violet white yellow"
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
STREETS = {
    "street": "st str", "road": "rd", "avenue": "ave av", "lane": "ln", "hill": "hl", "creek": "crk", "bridge": "br brg", "crossing": "xing crsg",
    "highway": "hwy", "airfield": "airfld", "drive": "dr", "court": "ct", "square": "sq", "place": "pl", "terrace": "ter", "way": "",
}

#: Minutes that two clocks may differ by, and the width of a time cell.
CLOCK = 30
#: Weight of a rule's prior, in labelled pairs.
PRIOR_WEIGHT = 20.0


@dataclass(frozen=True)
class Rule:
    """Exact join keys (names of key columns), a condition on the pair and a prior precision."""

    name: str
    left: tuple[str, ...]
    right: tuple[str, ...]
    also: str
    prior: float


_SAME_STREET = "(l_street <> '' and r_street <> '' and (l_street = r_street or levenshtein(l_street, r_street) <= 2))"
_ANY_STREET = f"({_SAME_STREET} or l_street = '' or r_street = '')"
_SHAPES = "(l_shape = '' or r_shape = '' or l_shape = r_shape)"
_NEAR_TIME = f"(l_minute is null or r_minute is null or least(abs(l_minute - r_minute), 1440 - abs(l_minute - r_minute)) <= {CLOCK})"

#: The cascade, strongest first. l_: compact record, r_: partner; keys named *_near are arrays of alternatives.
RULES = (
    Rule("date place facts", ("date", "place", "facts"), ("date", "place", "facts"), _SHAPES, 0.99),
    Rule("date place time street", ("date", "place", "time"), ("date", "place", "time"), f"{_ANY_STREET} and {_SHAPES} and (l_facts is null or r_facts is null)", 0.97),
    Rule("date place near-time street", ("date", "place", "cell"), ("date", "place", "cell_near"), f"{_SAME_STREET} and {_NEAR_TIME} and {_SHAPES} and (l_facts is null or r_facts is null)", 0.95),
    Rule("near-date place facts", ("date", "place", "facts"), ("date_near", "place", "facts"), f"{_NEAR_TIME} and {_ANY_STREET} and {_SHAPES}", 0.96),
    Rule("near-date place time street", ("date", "place", "time"), ("date_near", "place", "time"), f"{_SAME_STREET} and {_SHAPES} and (l_facts is null or r_facts is null)", 0.93),
    Rule("near-date place near-time street", ("date", "place", "cell"), ("date_near", "place", "cell_near"), f"{_SAME_STREET} and {_NEAR_TIME} and {_SHAPES} and (l_facts is null or r_facts is null)", 0.9),
    Rule("month place facts", ("month", "place", "facts"), ("month_only", "place", "facts"), f"{_NEAR_TIME} and {_ANY_STREET} and {_SHAPES}", 0.95),
    Rule("month place near-time street", ("month", "place", "cell"), ("month_only", "place", "cell_near"), f"{_SAME_STREET} and {_NEAR_TIME} and {_SHAPES} and (l_facts is null or r_facts is null)", 0.85),
    Rule("date place street", ("date", "place", "street"), ("date", "place", "street"), f"(l_minute is null or r_minute is null) and {_SHAPES} and (l_facts is null or r_facts is null)", 0.8),
    Rule("place facts time", ("undated", "place", "facts", "time"), ("undated", "place", "facts", "time"), f"{_ANY_STREET} and {_SHAPES}", 0.9),
    Rule("place facts street", ("undated", "place", "facts"), ("undated", "place", "facts"), f"{_SAME_STREET} and {_NEAR_TIME} and {_SHAPES}", 0.9),
    Rule("place time street", ("undated", "place", "time", "shape"), ("undated", "place", "time", "shape"), f"{_SAME_STREET} and (l_facts is null or r_facts is null)", 0.6),
)


def _lookup(value: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[value], value)


def features(records: DataFrame, places: DataFrame) -> DataFrame:
    """The attributes that rules compare, one row per input_id.

    A text's facts are its minutes, number of witnesses and first colour; a
    missing text, time, shape or date leaves its attribute null or empty.
    """
    text = F.lower(F.coalesce(F.when(F.trim("text_normalized") != "", F.col("text_normalized")), F.col("summary"), F.lit("")))
    minutes = F.regexp_extract("text", r"\b(\d{1,4})\s*min", 1)
    count = rf"(\d{{1,3}}|{'|'.join(NUMBERS.split())})"
    number = F.coalesce(F.nullif(F.regexp_extract("text", rf"\b{count}\s+(?:people|persons|witnesses)\b", 1), F.lit("")), F.nullif(F.regexp_extract("text", rf"\bwitnesses:?\s+{count}\b", 1), F.lit("")))
    number = _lookup(number, {w: str(i + 1) for i, w in enumerate(NUMBERS.split())})
    colour = F.regexp_extract("text", rf"\b({'|'.join(COLOURS.split())})\b", 1)
    short = {s: long for long, shorts in STREETS.items() for s in shorts.split()}
    kinds = "|".join([*STREETS, *short])
    where = F.lower(F.coalesce(F.col("location_text"), F.lit("")))
    street = F.regexp_extract(where, rf"\b([a-z]+)\s+({kinds})\b\.?\s*(?:$|[,/;\-])", 1)
    kind = F.regexp_extract(where, rf"\b([a-z]+)\s+({kinds})\b\.?\s*(?:$|[,/;\-])", 2)
    date = F.when(F.col("date_iso").rlike(r"^\d{4}-\d\d-\d\d$"), F.to_date(F.try_to_timestamp("date_iso", F.lit("yyyy-MM-dd"))))
    time = F.when(F.col("time_key").rlike(r"^([01]\d|2[0-3])[0-5]\d$"), F.col("time_key"))
    shape = F.regexp_replace(F.lower(F.trim(F.coalesce("shape_key", F.lit("")))), "[_-]+", " ")
    # whole texts are read here, and only what they tell goes on
    rec = records.where("input_id is not null").withColumn("text", text).select(
        "input_id", F.concat(F.lit("text:"), F.nullif(F.regexp_replace(where, r"[\W_]+", " "), F.lit(""))).alias("spelled"),
        date.alias("date"),
        F.coalesce(F.lower(F.trim("date_precision")) == "month", F.lit(False)).alias("coarse"),
        time.alias("time"),
        (F.substring(time, 1, 2).cast("int") * 60 + F.substring(time, 3, 2).cast("int")).alias("minute"),
        F.when((minutes != "") & number.isNotNull() & (colour != ""), F.concat_ws("|", minutes, number, colour)).alias("facts"),
        F.when(street == "", "").otherwise(F.concat_ws(" ", street, _lookup(kind, short))).alias("street"),
        F.when(shape.isin("unknown", "unk", "n/a", "none", "null", "-", "other"), "").otherwise(_lookup(shape, SHAPES)).alias("shape"),
    ).dropDuplicates(["input_id"])
    at = map_places(records.selectExpr("input_id as canonical_input_id", "location_text as location_raw", "location_region_key as state_province", "location_country_key as country"), places)
    rec = rec.join(at.selectExpr("canonical_input_id as input_id", "place_id"), "input_id", "left")
    rec = rec.withColumn("place", F.coalesce(F.when(F.col("place_id") != "none", F.col("place_id")), F.col("spelled"))).drop("place_id", "spelled")
    day, month = F.dayofmonth("date"), F.month("date")
    swap = F.when((day <= 12) & (day != month), F.make_date(F.year("date"), day, month))
    cell = F.floor(F.col("minute") / CLOCK).cast("int")
    cells = 1440 // CLOCK
    return rec.select(
        "*",
        F.array_distinct(F.array_compact(F.array(F.date_add("date", -1), F.date_add("date", 1), swap))).alias("date_near"),
        F.trunc("date", "month").alias("month"),
        F.when(F.col("coarse") & (day == 1), F.trunc("date", "month")).alias("month_only"),
        cell.alias("cell"),
        F.array(F.pmod(cell - 1, F.lit(cells)), cell, F.pmod(cell + 1, F.lit(cells))).alias("cell_near"),
        F.when(F.col("date").isNull(), F.lit(1)).alias("undated"),
    )


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in ("input_id", "facts", "street", "shape", "minute")] + [F.col(c).alias(c) for c in df.columns if c.startswith("k_")])


def apply_rule(rule: Rule, left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (l_input_id, r_input_id) that agree by the rule; missing keys agree with nothing."""

    def keyed(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
        for i, name in enumerate(names):
            value = F.col(name)
            if name.endswith("_near"):
                df = df.where(F.size(name) > 0)
                value = F.explode(name)
            df = df.withColumn(f"k_{i}", value)
        return df.dropna(subset=[f"k_{i}" for i in range(len(names))])

    undated = "undated" in rule.left
    # an undated rule pairs rows of which the partner, not the record, lacks its date
    a, b = keyed(left.withColumn("undated", F.lit(1)) if undated else left, rule.left), keyed(right, rule.right)
    keys = [f"k_{i}" for i in range(len(rule.left))]
    return _prefixed(a, "l_").join(_prefixed(b, "r_"), keys).where(rule.also).select("l_input_id", "r_input_id").distinct()


def labelled_precision(pairs: DataFrame, feats: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule, same, different: labelled pairs (left_input_id, right_input_id, verdict) that agree by each rule."""
    label = pairs.where(F.lower(F.trim("verdict")).isin("same", "different")).select(
        F.least(tidy_id(F.col("left_input_id")), tidy_id(F.col("right_input_id"))).alias("a"), F.greatest(tidy_id(F.col("left_input_id")), tidy_id(F.col("right_input_id"))).alias("b"), (F.lower(F.trim("verdict")) == "same").alias("same")
    )
    label = label.where("a <> b").groupBy("a", "b").agg(F.min("same").alias("same"), F.max("same").alias("most")).where("same = most").select("a", "b", "same")
    names = ["facts", "street", "shape", "minute", "date", "place", "time", "month", "cell", "date_near", "cell_near", "month_only"]
    one = feats.select(tidy_id(F.col("input_id")).alias("a"), *[F.col(c).alias(f"l_{c}") for c in names])
    two = feats.select(tidy_id(F.col("input_id")).alias("b"), *[F.col(c).alias(f"r_{c}") for c in names])
    both = label.join(one, "a").join(two, "b")

    def agrees(rule: Rule) -> Column:
        test = F.expr(rule.also)
        for x, y in zip(rule.left, rule.right, strict=True):
            if x != "undated":
                test = test & (F.array_contains(f"r_{y}", F.col(f"l_{x}")) if y.endswith("_near") else F.col(f"l_{x}") == F.col(f"r_{y}"))
        return F.coalesce(test, F.lit(False))

    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), agrees(r).alias("hit")) for r in rules])).alias("x")
    hits = both.select("same", rows).where("x.hit").select("same", "x.rule")
    return hits.groupBy("rule").agg(F.count_if("same").alias("same"), F.count_if(~F.col("same")).alias("different"))


def link(records: DataFrame, partners: DataFrame, places: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """record_id, partner_id, rule, confidence, same, different: pairs that describe the same sighting.

    ``records`` and ``partners`` are compact records, ``places`` the reference
    places that spell their location texts alike, ``labels`` verdicts on pairs of
    records. A partner leaves the cascade with the first rule that pairs it; a
    record can have several partners. Missing attributes agree with nothing unless
    a rule says so, repeated ids count once, empty tables give an empty result.
    confidence = (same + w p) / (same + different + w), with the rule's prior p and
    w = PRIOR_WEIGHT, over the labelled pairs that the rule would join.
    """
    names = ["input_id", "date_iso", "date_precision", "time_key", "location_text", "location_country_key", "location_region_key", "shape_key", "text_normalized", "summary"]
    # one pass over both sides; an id on both sides keeps its two rows apart by the mark
    sides = records.select(*names, F.lit(0).alias("side")).union(partners.select(*names, F.lit(1).alias("side")))
    every = cut(features(sides.withColumn("input_id", F.concat(F.col("side").cast("string"), "input_id")), places).withColumn("side", F.substring("input_id", 1, 1)).withColumn("input_id", F.expr("substring(input_id, 2)")))
    left, right = every.where("side = '0'").drop("side"), every.where("side = '1'").drop("side")
    found = None
    rest = right
    for rule in rules:
        hits = cut(apply_rule(rule, left, rest).select(F.col("l_input_id").alias("record_id"), F.col("r_input_id").alias("partner_id"), F.lit(rule.name).alias("rule")))
        found = hits if found is None else found.union(hits)
        rest = right.join(found.select(F.col("partner_id").alias("input_id")), "input_id", "left_anti")
    seen = labelled_precision(labels, left, rules)
    prior = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.prior)])[F.col("rule")]
    count = F.coalesce(F.col("same") + F.col("different"), F.lit(0))
    confidence = (F.coalesce(F.col("same"), F.lit(0)) + prior * PRIOR_WEIGHT) / (count + PRIOR_WEIGHT)
    return found.join(seen, "rule", "left").select("record_id", "partner_id", "rule", confidence.alias("confidence"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("same", "different")])
