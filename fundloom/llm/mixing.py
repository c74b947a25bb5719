"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the exponential key -ln(u) / weight, u from a hash of its id, so that taking a source's
documents by ascending key is a weighted sample without replacement. A source's target is split into complete
epochs, which take every document, and a rest, for which the documents in key order are prefix-summed up to the
budget. Only the key at which the budget ends is needed: the range of keys that holds it is summed in slots and
narrowed for all sources at once until few documents are left in it, whatever the distribution of the keys, and
only those are sorted. The selection is then a comparison with a row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.llm.shared import attach_null_safe, materialize, numbered

WORDS = r"[^\x20\x09-\x0D]+"
SEED = "mix"
#: Slots into which a range of keys is cut, and rows of a source from which on a range is sorted.
SLOTS, FEW = 256, 2_000


#: What the fitted weight looks at, in Spark: the share of signs that are neither letters nor digits, of capitals, of different words, and letters a word.
FEATURES = ("signs", "capitals", "different", "length")
SIGNS, CAPITALS = r"[^\p{L}\p{N}\s]", "[A-Z]"
LEAST_WEIGHT = 0.05


def featured(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, size, FEATURES, and more) of docs (doc_id, source, text): each text's words are found once."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source")]
    words = docs.select(*own, "text", F.regexp_extract_all("text", F.lit(WORDS), 0).alias("words"), *more)
    n, size, count = F.greatest(F.size("words"), F.lit(1)), F.greatest(F.length("text"), F.lit(1)), lambda p: F.regexp_count("text", F.lit(p))
    shares = {"signs": count(SIGNS) / size, "capitals": count(CAPITALS) / size, "different": F.size(F.array_distinct("words")) / n, "length": F.length("text") / n}
    kept = [c for c in words.columns if c not in ("doc_id", "source", "text", "words")]
    return words.select("doc_id", "source", F.greatest(F.size("words"), F.lit(0)).cast("long").alias("size"), *[F.coalesce(shares[f], F.lit(0.0)).alias(f) for f in FEATURES], *kept)


def fitted_weight(rows: DataFrame, labels: DataFrame) -> Column:
    """A weight by the FEATURES, from LEAST_WEIGHT to 1: the probability that a text is good, by what labelled documents are like.

    rows (doc_id and FEATURES), narrow, labels (doc_id, quality 0 or 1). Good and bad ones differ in the means of their
    features, with one variance for both (a linear discriminant that takes features as independent), which are sums
    over all labelled rows. A null or empty text has weight 1, and so has each without labels of both kinds.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("_quality"))
    own = rows.where("length > 0").select("doc_id", *FEATURES).join(known, "doc_id")
    stats = {r["_quality"]: r for r in own.groupBy("_quality").agg(F.count("*").alias("n"), *[F.round(F.avg(f), 9).alias(f) for f in FEATURES], *[F.round(F.var_pop(f), 9).alias(f"var_{f}") for f in FEATURES]).collect()}
    if len(stats) < 2:
        return F.lit(1.0)
    good, bad, score = stats[1], stats[0], F.lit(0.0)
    for f in FEATURES:
        spread = (good["n"] * good[f"var_{f}"] + bad["n"] * bad[f"var_{f}"]) / (good["n"] + bad["n"])
        if spread > 0:
            score = score + (F.col(f) - (good[f] + bad[f]) / 2) * ((good[f] - bad[f]) / spread)
    return F.when(F.col("length") > 0, F.greatest(F.lit(LEAST_WEIGHT), 1 / (1 + F.exp(-score)))).otherwise(1.0)


def sample_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """The exponential key at weight 1: of the id, or of the text where there is no id."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), own)), 1, 13), 16, 10)
    return -F.log((digits.cast("double") + 0.5) / float(2**52))


def measured(docs: DataFrame, labels: DataFrame | None, weight: Column | None, seed: str, fit_on: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """(doc_id, source, size, FEATURES, key, w) of each document, written, and the weight as a column of such rows, w where it is given."""
    key = sample_key(F.col("doc_id").cast("long"), F.col("text"), seed).alias("key")
    rows = materialize(featured(docs, key, (F.lit(1.0) if weight is None else weight).alias("w")), "sizes")
    if labels is None:
        return rows, F.col("w")
    return rows, fitted_weight(rows if fit_on is None else featured(fit_on), labels)


def _keyed(rows: DataFrame, weight: Column, *more: str) -> DataFrame:
    return rows.select("doc_id", "source", "size", (F.col("key") / weight).alias("key"), *more)


def targets(rows: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(source, nth, source_size, target) per source.

    Sources by code point, null last, get the weights in turn. Filled like vessels: those whose share exceeds
    `most` times their size stop there, and the level of the others rises until all is dealt. Each round of that is
    an aggregate over the sources, and a round follows only if a source has reached its stop.
    """
    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(sources.select("source", "nth", "source_size", turn.alias("w"), (most * F.col("source_size")).alias("cap")), "weights")
    total, level, before = share * (sources.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        full = F.col("cap") <= F.col("w") * level
        n, capped, free = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if n == before or not free:
            break
        before, level = n, (total - (capped or 0.0)) / free
    return sources.select("source", "nth", "source_size", F.when(F.col("cap") <= F.col("w") * level, F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def cuts(rows: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Per source: target, complete epochs, and what is taken once more: keys below `low`, and up to `last` in the order
    of key, doc_id and size; of rows that equal `last`, `at_last` of `tied`. No low: all; budget 0: none."""
    plan = targets(rows, weights, share, most)
    epochs = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan, "sources")
    keyed = attach_null_safe(rows, plan.where("budget > 0").select("source", "nth"), "source").select("nth", "doc_id", "size", "key")
    spans = keyed.groupBy("nth").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    spans = materialize(spans.join(plan.select("nth", "budget"), "nth").select("nth", "budget", "low", "high", "n", F.lit(0).cast("long").alias("before")), "spans")
    while spans.where((F.col("n") > FEW) & (F.col("low") < F.col("high"))).count():
        inside = keyed.join(spans.drop("n"), "nth").where("key between low and high")
        slot = F.when(F.col("low") < F.col("high"), F.least(F.lit(SLOTS - 1), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * SLOTS))).otherwise(0)
        slots = inside.groupBy("nth", "budget", "before", slot.alias("slot")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("nth").orderBy("slot"))
        slots = slots.withColumn("upto", upto).where("upto > budget")
        spans = materialize(
            slots.groupBy("nth", "budget").agg(F.min(F.struct("slot", "low", "high", "n", (F.col("upto") - F.col("words")).alias("before"))).alias("x")).select("nth", "budget", "x.low", "x.high", "x.n", "x.before"), "spans"
        )
    # Equal rows are one row here, with their number.
    inside = keyed.join(spans.drop("n"), "nth").where("key between low and high").groupBy("nth", "low", "before", "budget", "key", "doc_id", "size").agg(F.count("*").alias("tied"))
    order = Window.partitionBy("nth").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum(F.col("size") * F.col("tied")).over(order) - F.col("size") * F.col("tied")
    # A document that the budget cuts is taken if most of it is within.
    fit = F.when(F.col("size") == 0, F.when(F.col("start") <= F.col("budget"), F.col("tied"))).otherwise(F.floor((F.col("budget") - F.col("start")) / F.col("size") + 0.5))
    fitted = inside.withColumn("start", start).withColumn("fit", F.least("tied", fit))
    ends = fitted.groupBy("nth").agg(F.min("low").alias("low"), F.max(F.when(F.col("fit") > 0, F.struct(F.struct("key", "doc_id", "size").alias("last"), F.col("fit").alias("at_last"), "tied"))).alias("x"))
    return materialize(plan.join(ends.select("nth", "low", "x.*"), "nth", "left").drop("nth"), "cuts")


def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, key, ...) with source_size, target and copies, the times that the mix takes each."""
    place = F.struct("key", "doc_id", "size")
    last = F.col("last")
    known = attach_null_safe(rows, plan, "source")
    below = F.col("low").isNull() | (F.col("key") < F.col("low")) | F.coalesce(place < last, F.lit(False))
    ties = F.coalesce(place == last, F.lit(False)) | F.coalesce((F.col("key") == last["key"]) & F.col("doc_id").eqNullSafe(last["doc_id"]) & (F.col("size") == last["size"]), F.lit(False))
    own = [*rows.columns, "source_size", "target"]
    if plan.where("at_last < tied").isEmpty():
        return known.select(*own, (F.col("epochs") + ((F.col("budget") > 0) & (below | ties)).cast("long")).alias("copies"))
    # Equal rows of which some are taken: they are written once, so that each keeps its number.
    some = ties & (F.col("at_last") < F.col("tied"))
    plain = known.where(~some).select(*own, (F.col("epochs") + ((F.col("budget") > 0) & (below | ties)).cast("long")).alias("copies"))
    equal = materialize(known.where(some).select(*own, "epochs", "at_last", F.monotonically_increasing_id().alias("_row")), "ties")
    part = F.shiftright("_row", 33)
    before = equal.groupBy("source", part.alias("_part")).agg(F.count("*").alias("_n"))
    before = before.select(F.col("source").alias("_source"), "_part", (F.sum("_n").over(Window.partitionBy("source").orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("source", part).orderBy("_row"))
    ranks = equal.select("source", "_row", part.alias("_part"), within.alias("_rank"))
    ranks = ranks.join(before, F.col("source").eqNullSafe(F.col("_source")) & (ranks["_part"] == before["_part"])).select("_row", (F.col("_rank") + F.col("_before")).alias("_rank"))
    return plain.unionByName(equal.join(ranks, "_row").select(*own, (F.col("epochs") + (F.col("_rank") <= F.col("at_last")).cast("long")).alias("copies")))


def mix(docs: DataFrame, weights: list[int] | None = None, share: float = 1.5, most: float = 2.0, weight: Column | None = None, seed: str = SEED, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) per document of docs (doc_id, source, text, ...).

    labels (doc_id, quality 0 or 1): documents are weighed by `fitted_weight`; without them by weight, a column of docs,
    or all alike. A null text has size 0 and nothing of it is taken; a null source is a source of its own. The key of a
    row without doc_id comes from its text. Repeated rows count each, and as many of them are taken as fit; equal keys
    go by doc_id, then by size. A source of size 0 has target 0. Labels that are null, of other values or of other
    documents are ignored. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows, by = measured(docs, labels, weight, seed)
    rows = _keyed(rows, by)
    plan = cuts(rows, weights or [5, 2, 1], share, most)
    return copies(rows, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixed_documents(
    docs: DataFrame, weights: list[int] | None = None, share: float = 1.5, most: float = 2.0, weight: Column | None = None, seed: str = SEED, labels: DataFrame | None = None, fit_on: DataFrame | None = None
) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; all columns of docs. Nulls, ties, repeated rows and empty tables: as in `mix`.

    fit_on (doc_id, text): the documents that the weight is fitted on, docs by default.
    """
    rows, by = measured(docs, labels, weight, seed, fit_on)
    plan = cuts(_keyed(rows, by), weights or [5, 2, 1], share, most)
    own = sample_key(F.col("doc_id").cast("long"), F.col("text"), seed).alias("key")
    again = featured(docs, own, (F.lit(1.0) if weight is None else weight).alias("w"), F.struct("*").alias("row"))
    out = copies(_keyed(again, by, "row"), plan).where("copies > 0").select("row", F.explode(F.expr("array_repeat(0, int(copies))")))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


_RATES = ", ".join(f"""(good.{f} - bad.{f}) / nullif((good.n * good.var_{f} + bad.n * bad.var_{f}) / (good.n + bad.n), 0) as rate_{f}, (good.{f} + bad.{f}) / 2 as mid_{f}""" for f in FEATURES)
_SCORE = " + ".join(f"({f} - mid_{f}) * coalesce(rate_{f}, 0)" for f in FEATURES)

#: The same in DuckDB: weights by the labelled documents' features, targets by levels over the sources in the order in which they reach their stop.
SQL = rf"""
with worded as (select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as l from documents),
featured as (
  select doc_id, source, text, cast(coalesce(len(l), 0) as bigint) as size, len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\s]'))::double / greatest(length(text), 1) as signs, len(regexp_extract_all(text, '[A-Z]'))::double / greatest(length(text), 1) as capitals,
    len(list_distinct(l))::double / greatest(len(l), 1) as different, length(text)::double / greatest(len(l), 1) as length from worded),
stats as (
  select quality, count(*)::double as n, {", ".join(f"round(avg({f}), 9) as {f}, round(var_pop({f}), 9) as var_{f}" for f in FEATURES)} from featured join labels using (doc_id) where quality in (0, 1) and length(text) > 0 group by quality),
rates as (select {_RATES} from stats good, stats bad where good.quality = 1 and bad.quality = 0),
sized as (
  select doc_id, source, size, -ln((cast('0x' || substr(md5('{SEED}' || coalesce(cast(doc_id as varchar), 'text ' || md5(coalesce(text, '')))), 1, 13) as bigint) + 0.5::double) / 4503599627370496::double)
    / case when length(text) > 0 then greatest({LEAST_WEIGHT}::double, 1 / (1 + exp(-(coalesce({_SCORE}, 100))))) else 1.0::double end as key
  from featured left join rates on true),
weighed as (
  select source, sum(size)::bigint as source_size, case row_number() over (order by source nulls last) % 3 when 1 then 5.0::double when 2 then 2.0::double else 1.0::double end as w, 2.0::double * sum(size)::bigint as cap
  from sized group by source),
levels as (
  select *, row_number() over o as nth,
    (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
      / (sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0)) as level
  from weighed window o as (order by cap / w, source nulls last)),
final as (select coalesce(arg_min(level, nth), 0) as level from levels where level < cap / w),
target as (select source, source_size, least(cap, w * final.level) as target from levels, final),
budget as (
  select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as bigint) as epochs,
    target - cast(case when source_size > 0 then floor(target / source_size) else 0 end as bigint) * source_size as budget
  from target),
summed as (
  select doc_id, size, source_size, target, epochs, budget, sized.source,
    sum(size) over (partition by sized.source order by key, doc_id, size rows unbounded preceding) - size as start
  from sized join budget on sized.source is not distinct from budget.source)
select doc_id, size, source_size, target, cast(size * (epochs + case when budget > 0 and start + size / 2.0 <= budget then 1 else 0 end) as bigint) as taken,
  source, cast(epochs + case when budget > 0 and start + size / 2.0 <= budget then 1 else 0 end as bigint) as copies
from summed"""
