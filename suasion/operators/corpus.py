"""Corpus tooling: scrubbing, de-duplication, recruiting and splitting of labelled text, label logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suasion.functions.text import dedup_key, title_similarity, trigrams

# fixed values: personal data, in the order in which it is masked
SCRUB = (
    (r"[\w.+-]+@[\w-]+\.[\w.]{2,}", "user@example.test"),
    (r"\+?\d[\d\s().-]{8,}\d", "+1-555-0100"),
    (r"\b\d{1,5}\s+[A-Z][a-z]+\s+(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Ln|Lane|Dr|Drive)\b", "1 Example St"),
    (r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b", "SW1A 1AA"),
    (r"\b\d{5}(?:-\d{4})?\b", "00000"),
    (r"\b(?:\d[ -]*?){13,19}\b", "4111111111111111"),
    (r"\beyJ[\w-]+\.[\w-]+\.[\w-]+", "<jwt>"),
    (r"(?i)\b(?:order|account|member|customer)\s*#?\s*[A-Z0-9]{8,}\b", "order #REDACTED"),
)
# fixed values: what reads as a date, as a statement, as an advertisement
DATE_LIKE = r"(?i)\b(?:mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b[,.]?\s*\d"
SOCIAL_ALT = r"(?i)'s (?:instagram|tiktok) (?:image|photo|video)"
STATEMENT = r"(?i)[.!?]|\b(?:is|are|was|were|has|have|get|save|only|left|ends?|now|you|your|we|our|hurry|shop|add|spend|pay|join|sold|order|ship|free|off)\b"
PROMOTIONAL = r"(?i)\d|[$£€%]|\b(?:now|today|free|save|get|only|new|off)\b"


def scrub(text: Column) -> Column:
    """Personal data masked by ordered rules; scrubbing twice changes nothing more."""
    out = text
    for pattern, mask in SCRUB:
        out = F.regexp_replace(out, pattern, mask.replace("$", r"\$"))
    return out


def lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row for each non-blank line, with its position."""
    cut = documents.select("*", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).drop(text)
    return cut.filter(F.trim("line") != "")


def first_of_key(rows: DataFrame, key: Column, order: list[str | Column]) -> DataFrame:
    """The first row of each key: a grouped minimum, so a key that half the rows share costs one row per task."""
    everything = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)], *rows.columns)
    best = rows.groupBy(key.alias("_key")).agg(F.min(everything).alias("_row"))
    return best.select(*(F.col(f"_row.{c}").alias(c) for c in rows.columns))


def dedup_lines_by_key(rows: DataFrame, order: list[str | Column], text: str = "line") -> DataFrame:
    """Of lines that differ in numbers, case or blanks alone, the first."""
    return first_of_key(rows, dedup_key(F.col(text)), order)


def looks_like_a_message(text: Column) -> Column:
    """Said to a shopper, rather than a name, a caption or a field."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    field = text.rlike(r"^[A-Z][a-z]+:\s") & (F.length(text) < 32)
    title = (capital / F.greatest(F.size(words), F.lit(1)) > 0.6) & ~text.rlike(STATEMENT)
    return ~text.rlike(SOCIAL_ALT) & ~field & (F.size(words) >= 3) & ~title


def plausible(text: Column) -> Column:
    return F.length(text).between(8, 180) & text.rlike(r"\s") & text.rlike(PROMOTIONAL)


def tier(text: Column, strict: str, loose: str) -> Column:
    """A: the strict words, B: a message with the loose words, C: a plausible message, else null."""
    message = looks_like_a_message(text)
    return F.when(~text.rlike(DATE_LIKE) & text.rlike(strict), "A").when(message & text.rlike(loose), "B").when(message & plausible(text), "C")


def build_queue(rows: DataFrame, per_pattern: int = 300, seed: str | None = None) -> DataFrame:
    """Balanced picks of one pattern's tiers: 35 % A, 65 % B at most, and no more C than A and B together. Needs tier, ord.

    With a seed the rows of a tier are picked in the order of a hash of seed and ord, the same for the same seed.
    """
    order = ("ord",) if seed is None else (F.sha2(F.concat_ws(":", F.lit(seed), F.col("ord").cast("string")), 256), "ord")
    counts = rows.groupBy().pivot("tier", ["A", "B", "C"]).count().na.fill(0)
    a, b = F.least("A", F.lit(round(per_pattern * 0.35))), F.least("B", F.lit(round(per_pattern * 0.65)))
    want = counts.select(a.alias("wa"), b.alias("wb"), F.least(F.col("C"), a + b, F.lit(per_pattern) - a - b).alias("wc"))  # one row
    wanted = want.select(F.explode(F.map_from_arrays(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.array("wa", "wb", "wc"))).alias("tier", "want"))
    nth = F.row_number().over(Window.partitionBy("tier").orderBy(*order))
    # no tier gives more than per_pattern rows, so each task sends on that many of a tier at most
    first = rows.withColumn("_nth", nth).filter(F.col("_nth") <= per_pattern)
    return first.join(F.broadcast(wanted), "tier").filter(F.col("_nth") <= F.col("want")).drop("_nth", "want")


def cap_per_site(rows: DataFrame, cap: int, site: str = "site", order: str = "ord") -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(site).orderBy(order))).filter(F.col("_nth") <= cap).drop("_nth")


def holdout_by_site(rows: DataFrame, every: int = 4, site: str = "site") -> DataFrame:
    """Every fourth site, in name order, is held out. The sites are few; rows are joined, not ranked."""
    sites = rows.select(site).distinct()
    ranked = sites.withColumn("held_out", (F.row_number().over(Window.orderBy(site)) - 1) % every == every - 1)
    return rows.join(F.broadcast(ranked), site)


def numbered(rows: DataFrame, key: str, order: str, buckets: int = 1024) -> DataFrame:
    """The rows with ``_nth``, their number (from 0) within ``key`` by a numeric ``order``.

    Each key is cut into equal ranges of the order, numbered on their own, and the counts of the ranges before (at most
    ``buckets`` numbers for each key) are added: a key with a third of all rows is not sorted in one task.
    """
    ends = rows.groupBy(F.col(key).alias("_of")).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    cut = F.least(F.lit(buckets - 1), F.floor((F.col(order) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1)) * buckets)).cast("int")
    placed = rows.join(ends, F.col(key).eqNullSafe(F.col("_of"))).withColumn("_cut", cut).drop("_low", "_high", "_of")
    counts = placed.groupBy(F.col(key).alias("_of"), F.col("_cut").alias("_at")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(key, "_cut").orderBy(order)) - 1
    joined = placed.withColumn("_own", own).join(counts.select("_of", "_at", before.alias("_before")), F.col(key).eqNullSafe(F.col("_of")) & (F.col("_cut") == F.col("_at")))
    return joined.withColumn("_nth", F.col("_own") + F.col("_before")).drop("_own", "_before", "_of", "_at", "_cut")


#: About so many keys of one name go together.
CHUNK = 512


def similar_names(names: DataFrame, within: tuple[str, ...], least: float) -> DataFrame:
    """(name, other_name, similarity, *within) of pairs of distinct names, name first in order, whose trigrams overlap enough.

    Two sets of n trigrams that overlap so much share one of the first n - ceil(least * n) + 1 of each in any common order;
    rare trigrams come first in it. A pair meets once on these and is then measured. The trigram counts are broadcast: of
    names in a-z, 0-9 and blanks there are 37 ** 3 trigrams at most.
    """
    grams = names.select("name", *within, F.explode(trigrams(F.col("name"))).alias("g"))
    counts = grams.groupBy("g").agg(F.count("*").alias("df"))
    ordered = grams.join(F.broadcast(counts), "g").groupBy("name", *within).agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    n = F.size("o")
    prefix = F.slice("o", 1, (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
    placed = ordered.select("name", *within, n.alias("n"), F.posexplode(F.transform(prefix, lambda x: x["g"])).alias("at", "g"))
    other = placed.select(F.col("name").alias("other_name"), *within, "g", F.col("n").alias("m"), F.col("at").alias("other_at"))
    # of sets as unlike in size, or that have too little left behind the first trigram they share, none are alike enough
    sized = (F.col("n") >= F.col("m") * least - 1e-9) & (F.col("m") >= F.col("n") * least - 1e-9)
    rest = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("other_at"))
    enough = rest * (1 + least) >= (F.col("n") + F.col("m")) * least - 1e-9
    pairs = placed.join(other, ["g", *within]).filter((F.col("name") < F.col("other_name")) & sized & enough).select("name", "other_name", *within).distinct()
    similarity = F.round(title_similarity(F.col("name"), F.col("other_name")), 9)
    return pairs.withColumn("similarity", similarity).filter(F.col("similarity") >= least)


def similar_titles(titles: DataFrame, key: str, within: tuple[str, ...], least: float) -> DataFrame:
    """(key, other, similarity) of all pairs of names in the same ``within`` whose trigrams overlap enough; key < other.

    Names are compared once, however many titles have them: only what is alike is spread over the keys again. Titles of one
    name are alike; a null name is like none.
    """
    spark, group = titles.sparkSession, ["name", *within]
    named = titles.select(key, *group).filter("name is not null")
    names = named.select(*group).distinct()
    alike = similar_names(names, within, least).unionByName(names.withColumns({"other_name": F.col("name"), "similarity": F.lit(1.0)}))
    # a name's keys go in chunks, and pairs of chunks are dealt evenly: neither a name's keys nor its pairs lie in one task
    chunks = named.groupBy(*group).agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    chunked = named.join(chunks, group).groupBy(*group, F.pmod(F.xxhash64(key), F.col("_chunks")).alias("_chunk")).agg(F.collect_list(key).alias("_keys"))
    others = chunked.select(F.col("name").alias("other_name"), *within, F.col("_chunk").alias("_other_chunk"), F.col("_keys").alias("_other_keys"))
    met = chunked.join(alike, group).join(others, ["other_name", *within]).withColumn("_same", F.col("name") == F.col("other_name"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = met.filter(~F.col("_same") | (F.col("_chunk") <= F.col("_other_chunk"))).withColumn("_self", F.col("_same") & (F.col("_chunk") == F.col("_other_chunk"))).select("similarity", "_self", "_keys", "_other_keys").repartition(tasks)
    pairs = dealt.select("similarity", "_self", "_other_keys", F.explode("_keys").alias("_one")).select("similarity", "_self", "_one", F.explode("_other_keys").alias("_two"))
    once = (F.col("_one") < F.col("_two")) | (~F.col("_self") & (F.col("_one") != F.col("_two")))
    return pairs.filter(once).select(F.least("_one", "_two").alias(key), F.greatest("_one", "_two").alias("other"), "similarity")


def stride_negatives(rows: DataFrame, label: str = "label", order: str = "ord", per_positive: int = 4, least: int = 40) -> DataFrame:
    """All positives, and evenly spaced negatives: four for each positive, forty at least."""
    sizes = rows.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).select(F.greatest(F.col("pos") * per_positive, F.lit(least)).alias("want"), "neg")
    step = F.col("neg") / F.col("want")
    at = F.ceil(F.col("_nth") / step)  # the pick whose place this row may be
    taken = (F.floor(at * step) == F.col("_nth")) & (at < F.col("want"))
    return numbered(rows, label, order).join(F.broadcast(sizes), F.lit(True)).filter((F.col(label) == 1) | (F.col("want") >= F.col("neg")) | taken).drop("_nth", "want", "neg")


def resolve_labels(log: DataFrame, key: tuple[str, ...] = ("pattern_id", "key"), seq: str = "seq") -> DataFrame:
    """Latest entry of each key wins; a key whose latest entry is an undo is gone."""
    last = log.groupBy(*key).agg(F.max_by(F.struct(*[c for c in log.columns if c not in key]), seq).alias("r"))
    return last.select(*key, "r.*").filter(~F.col("undo")).drop("undo")


def human_over_auto(human: DataFrame, auto: DataFrame, key: tuple[str, ...] = ("pattern_id", "key")) -> DataFrame:
    """Automatic labels only where no person has labelled."""
    return human.unionByName(auto.join(human.select(*key), list(key), "left_anti"))


def fan_out(labels: DataFrame) -> DataFrame:
    """'No, but it is that one': a negative for the pattern asked and a positive for the other."""
    own = F.struct(F.col("pattern_id"), F.col("label"))
    other = F.struct(F.col("also_pattern").alias("pattern_id"), F.lit(1).alias("label"))
    both = F.when(F.col("also_pattern").isNotNull() & (F.col("also_pattern") != "other"), F.array(own, other)).otherwise(F.array(own))
    return labels.select("key", F.explode(both).alias("p")).select("key", "p.pattern_id", "p.label")


def confusion(scored: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall and F1 (0 where undefined) of score against label."""
    hit, yes = F.col("score") >= threshold, F.col("label") == 1
    c = scored.groupBy(*by).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).withColumn("precision", p).withColumn("recall", r)
    return c.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))))


def thresholds() -> list[float]:
    """From 0.05 by repeated addition of 0.05 while at most 0.95."""
    out, t = [], 0.05
    while t <= 0.95:
        out.append(t)
        t += 0.05
    return out


def best_threshold(scored: DataFrame) -> DataFrame:
    """The threshold of best F1, the smallest on ties: one pass, each row counted at all eighteen."""
    swept = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds()))))
    hit, yes = F.col("score") >= F.col("threshold"), F.col("label") == 1
    c = swept.groupBy("threshold").agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"))
    f1 = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return c.withColumn("f1", f1).orderBy(F.desc("f1"), "threshold").limit(1)
