"""All named queries outside the language-model subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suasion.plans import archive, files, gates, markup, measures, patterns, shop, streams, tooling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**measures.QUERIES, **patterns.QUERIES, **tooling.QUERIES, **streams.QUERIES, **archive.QUERIES, **shop.QUERIES, **files.QUERIES, **gates.QUERIES, **markup.QUERIES}
ORACLE_SQL: dict[str, str] = {**measures.ORACLE_SQL, **patterns.ORACLE_SQL, **tooling.ORACLE_SQL, **streams.ORACLE_SQL, **archive.ORACLE_SQL, **shop.ORACLE_SQL, **files.ORACLE_SQL, **gates.ORACLE_SQL, **markup.ORACLE_SQL}
