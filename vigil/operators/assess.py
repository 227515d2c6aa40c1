"""What evidence can support: presence of fields, dimensions, gates on indicators, and scores that keep absence apart
from zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.policy import DEFAULT, Policy

STATES = ("NOT_ASSESSABLE", "PARTIAL", "ASSESSABLE")


def presence(entities: DataFrame, tables: dict[str, tuple[DataFrame, list[str], Column]]) -> DataFrame:
    """(entity_id, tbl, col, n_rows, n_present, declared) for every entity. tables: name -> (rows, columns, whether the
    entity submitted the table). One pass over each table counts all its columns; col '*' is the table itself."""
    out = []
    for name, (rows, columns, declared) in tables.items():
        counted = rows.groupBy("entity_id").agg(F.count("*").alias("n_rows"), *(F.count(c).alias(f"n_{c}") for c in columns))
        whole = entities.select("entity_id", declared.alias("declared")).join(counted, "entity_id", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        cells = [F.struct(F.lit("*").alias("col"), zero("n_rows").alias("n_present")), *(F.struct(F.lit(c).alias("col"), zero(f"n_{c}").alias("n_present")) for c in columns)]
        out.append(whole.select("entity_id", F.lit(name).alias("tbl"), zero("n_rows").alias("n_rows"), "declared", F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, out)


def field_state() -> Column:
    """present, or why not: never_submitted, no_rows, empty_column."""
    return F.when(~F.col("declared"), "never_submitted").when(F.col("n_rows") == 0, "no_rows").when(F.col("n_present") == 0, "empty_column").otherwise("present")


def achieved_tier(fields: DataFrame) -> DataFrame:
    """(entity_id, tier): A with alerts and cases, B with cases, events or escalations, else C."""
    has = lambda *names: F.max(F.when(F.col("tbl").isin(*names), F.col("n_rows")).otherwise(0)) > 0
    tier = F.when(has("case_record") & has("alert_record"), "A").when(has("case_record", "case_event", "escalation"), "B").otherwise("C")
    return fields.groupBy("entity_id").agg(tier.alias("tier"))


def resolved(fields: DataFrame, requirements: DataFrame, tiers: DataFrame) -> DataFrame:
    """(entity_id, fields) against (dimension, tbl, col, kind, min_tier): the state of each dimension. Missing required
    fields decide; missing optional ones and soft caps lower; the tier can only lower."""
    rows = fields.withColumn("state", field_state()).join(F.broadcast(requirements), ["tbl", "col"])  # a row for each requirement
    gone = F.col("state") != "present"
    name = F.when(F.col("col") == "*", F.col("tbl")).otherwise(F.concat_ws(".", "tbl", "col"))
    per = rows.groupBy("entity_id", "dimension", "min_tier").agg(
        F.max((gone & (F.col("kind") == "required")).cast("int")).alias("blocked"), F.max((gone & (F.col("kind") != "required")).cast("int")).alias("lowered"),
        F.sort_array(F.collect_set(F.when(gone, name))).alias("missing"), F.sort_array(F.collect_set(F.when(gone, F.col("tbl")))).alias("tables"),
    ).join(tiers, "entity_id")
    short = F.col("tier") > F.col("min_tier")  # A before B before C
    state = F.when(F.col("blocked") == 1, STATES[0]).when((F.col("lowered") == 1) | short, STATES[1]).otherwise(STATES[2])
    tables = F.when(F.size("tables") > 0, F.col("tables")).otherwise(F.array(F.lit("submission")))
    return per.select("entity_id", "dimension", state.alias("state"), F.array_join("missing", ",").alias("missing"), "tier", tables.alias("tables"))


def gated(fields: DataFrame, needs: DataFrame) -> DataFrame:
    """(entity_id, indicator, presence, missing) by (indicator, tbl, col, disqualifies): all fields missing or one that
    disqualifies is not assessable, some missing is partial."""
    rows = fields.withColumn("gone", field_state() != "present").join(F.broadcast(needs), ["tbl", "col"])
    per = rows.groupBy("entity_id", "indicator").agg(F.count("*").alias("k"), F.count(F.when(F.col("gone"), 1)).alias("g"), F.max((F.col("gone") & F.col("disqualifies")).cast("int")).alias("d"), F.sort_array(F.collect_set(F.when(F.col("gone"), F.concat_ws(".", "tbl", "col")))).alias("missing"))
    state = F.when(F.col("g") == 0, STATES[2]).when((F.col("g") == F.col("k")) | (F.col("d") == 1), STATES[0]).otherwise(STATES[1])
    return per.select("entity_id", "indicator", state.alias("presence"), F.array_join("missing", ",").alias("missing"))


def assembled(entities: DataFrame, values: DataFrame, gates: DataFrame, tiers: DataFrame, trust: DataFrame, specs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Every indicator of every entity. values: (entity_id, indicator, value, n, effect, n_evidence) where there were rows;
    trust: (entity_id, dq_score); specs: (indicator, family, dimension, min_tier).

    A tier or presence gate that fails leaves no value at all. Otherwise an empty population has value 0, and confidence
    is the product of sample, assessability and trust; unknown trust counts a half and makes the result partial.
    """
    rows = entities.select("entity_id").crossJoin(F.broadcast(specs))  # a row for each indicator
    rows = rows.join(gates, ["entity_id", "indicator"], "left").join(tiers, "entity_id").join(trust, "entity_id", "left").join(values, ["entity_id", "indicator"], "left")
    state = F.when(F.col("tier") > F.col("min_tier"), STATES[0]).otherwise(F.coalesce("presence", F.lit(STATES[2])))
    rows = rows.withColumn("state", state).withColumn("open", F.col("state") != STATES[0])
    full = F.when((F.col("state") == STATES[2]) & F.col("dq_score").isNotNull(), 1.0).otherwise(0.5)
    n = F.coalesce("n", F.lit(0))
    confidence = F.least(F.lit(1.0), n / policy.full_confidence_n) * full * F.coalesce("dq_score", F.lit(0.5))
    when = lambda c: F.when(F.col("open"), c)
    return rows.select(
        "entity_id", "indicator", "family", "dimension", "state", when(F.coalesce("value", F.lit(0.0))).alias("value"), when(n).alias("n"), when(F.col("effect")).alias("effect"),
        when(F.round(confidence, 6)).alias("confidence"), when(F.coalesce("n_evidence", F.lit(0)) == 0).alias("lead"), "missing", "dq_score",
    )


def data_trust(results: DataFrame) -> DataFrame:
    """(entity_id, dts): half the submission's quality, half the share of indicators that gave a value; unknown stays so."""
    share = F.avg(F.col("value").isNotNull().cast("int"))
    return results.groupBy("entity_id").agg(F.round(0.5 * F.first("dq_score") + 0.5 * share, 6).alias("dts"))


def damped(results: DataFrame, trust: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Confidence in proportion where trust lies below the floor."""
    low = F.when(F.col("dts") < policy.dts_floor, F.col("confidence") * F.col("dts") / policy.dts_floor)
    return results.join(trust, "entity_id").withColumn("confidence", F.coalesce(low, F.col("confidence")))


def noisy_or(score: str, weight: str, cap: float) -> Column:
    """1 - product of (1 - weight * capped score); factors stay above zero, so logarithms add up."""
    return F.round(1 - F.exp(F.sum(F.log(1 - F.col(weight) * F.least(F.col(score), F.lit(cap))))), 6)


def scorecards(signals: DataFrame, dimensions: DataFrame, trust: DataFrame, families: DataFrame, weights: DataFrame, policy: Policy = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(dimension scores, entity scores).

    signals: (entity_id, indicator, family, dimension, effect, confidence, survives) of admitted indicators; dimensions:
    (entity_id, dimension, state) of every entity; families: (family, w, part) with part egi or nsi; weights:
    (dimension, w). A dimension that is not assessable or has no indicator has no score; none of the parts means no
    index. Partial dimensions count half in the mean. Tiers are withheld where too little could be measured.
    """
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("effect") - policy.ramp_z0) / (policy.ramp_z1 - policy.ramp_z0)))
    signal = F.when(F.col("survives"), ramp * F.col("confidence")).otherwise(0.0)
    family = signals.groupBy("entity_id", "dimension", "family").agg(F.max(signal).alias("s")).join(F.broadcast(families), "family")
    open_ = dimensions.select("entity_id", "dimension", "state")
    scored = family.join(open_.filter(F.col("state") != STATES[0]), ["entity_id", "dimension"])
    scores = scored.groupBy("entity_id", "dimension").agg(noisy_or("s", "w", policy.family_cap).alias("score"))
    slack = F.when(F.col("survives") & (F.col("effect") != 0), F.abs("effect") / F.sqrt(F.greatest(F.lit(1.0), F.col("confidence") * policy.full_confidence_n)))
    span = signals.groupBy("entity_id").agg(F.least(F.lit(0.25), 0.05 * F.coalesce(F.max(slack), F.lit(0.0))).alias("span"))
    dims = open_.join(scores, ["entity_id", "dimension"], "left").join(span, "entity_id", "left").withColumn("span", F.coalesce("span", F.lit(0.0)))
    dims = dims.select("entity_id", "dimension", "state", "score", F.round(F.greatest(F.lit(0.0), F.col("score") - F.col("span")), 6).alias("low"), F.round(F.least(F.lit(1.0), F.col("score") + F.col("span")), 6).alias("high"))
    part = scored.groupBy("entity_id", "family", "part", "w").agg(F.max("s").alias("s"))
    index = part.groupBy("entity_id").pivot("part", ["egi", "nsi"]).agg(noisy_or("s", "w", policy.family_cap))
    share = F.when(F.col("score").isNotNull(), F.when(F.col("state") == STATES[1], 0.5).otherwise(1.0)) * F.col("w")
    whole = dims.join(F.broadcast(weights), "dimension").groupBy("entity_id").agg(
        F.round(F.sum(share * F.col("score")) / F.sum(share), 6).alias("sap"), F.round(F.sum(F.when(F.col("score").isNotNull(), F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("measurable"),
        F.count("score").alias("n_measured"), F.count("*").alias("n_all"), F.count(F.when(F.col("state") == STATES[2], 1)).alias("n_full"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("score").isNull(), F.col("dimension")))), ",").alias("unscored"),
    )
    overall = F.when(F.col("n_measured") == 0, STATES[0]).when((F.col("n_measured") == F.col("n_all")) & (F.col("n_full") == F.col("n_all")), STATES[2]).otherwise(STATES[1])
    high, mid, low = policy.tiers
    tier = F.when(F.col("sap").isNull() | (F.col("measurable") < policy.min_measurable), "not_assessable").when(F.col("sap") >= high, "T1").when(F.col("sap") >= mid, "T2").when(F.col("sap") >= low, "T3").otherwise("T4")
    entity = whole.join(index, "entity_id", "left").join(trust, "entity_id", "left").withColumn("overall", overall).withColumn("tier", tier)
    caveat = F.array_compact(F.array(F.when(F.col("dts").isNull(), "no data quality on record"), F.when(F.col("dts") < policy.dts_floor, "data trust below the floor"), F.when(F.col("unscored") != "", F.concat(F.lit("not scored: "), F.col("unscored")))))
    return dims, entity.withColumn("caveats", F.array_join(caveat, "; ")).drop("n_measured", "n_all", "n_full", "unscored")
