"""Fixture pages that hold no personal data: what is written is checked in the pass that writes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from suasion.functions.fixtures import EMAIL, RULES, pii_hits

RULE_NAMES = (EMAIL[0], "card-number", *(name for name, _, _ in RULES))


class PersonalData(ValueError):
    """Pages with personal data were refused; ``hits`` has how many finds each rule made, ``kept`` how many pages were written."""

    def __init__(self, hits: dict[str, int], kept: int) -> None:
        super().__init__(f"personal data, by rule: {hits}; {kept} pages without any were written")
        self.hits, self.kept = hits, kept


def write_clean(pages: DataFrame, path: str, text: str = "html") -> int:
    """Write the pages without personal data to a new folder, and raise PersonalData if there were others.

    One scan: the finds are counted as the rows pass by, so the job that writes is the job that fails, and its folder never
    holds a page with a find. A null text has none. Returns how many pages were written.
    """
    seen, hits = Observation(), F.col("_hits")
    counts = [F.sum(F.coalesce(F.try_element_at(hits, F.lit(rule)), F.lit(0))).alias(rule) for rule in RULE_NAMES]
    watched = pages.withColumn("_hits", F.coalesce(pii_hits(F.col(text)), F.create_map().cast("map<string,int>")))
    counted = watched.observe(seen, F.count_if(F.size(hits) == 0).alias("_kept"), *counts)
    counted.filter(F.size(hits) == 0).drop("_hits").write.parquet(path)
    found = {rule: n for rule in RULE_NAMES if (n := seen.get[rule])}
    if found:
        raise PersonalData(found, seen.get["_kept"])
    return seen.get["_kept"]
