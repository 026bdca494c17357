"""Configuration files: locations, variation patterns, product groups. Invalid ones stop the job."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from restomart import fixed_values as V
from restomart.functions.names import NameConfig

LOCATION_DDL = "position int, name string, toast_id string, doordash_id string, square_id string"


class ConfigError(ValueError):
    """All problems of a configuration, one per line."""


def _need_text(problems: list[str], entry: dict, path: str, *names: str) -> None:
    for name in names:
        if not isinstance(entry.get(name), str) or not entry[name]:
            problems.append(f"{path}.{name}: required")


def _need_list(problems: list[str], config: dict, name: str) -> list:
    entries = config.get(name)
    if not isinstance(entries, list) or not entries:
        problems.append(f"{name}: at least one entry is required")
        return []
    return entries


def check_locations(config: dict) -> list[str]:
    problems: list[str] = []
    for i, entry in enumerate(_need_list(problems, config, "locations")):
        _need_text(problems, entry, f"locations.{i}", "name", "toast_id", "doordash_id", "square_id")
    return problems


def check_patterns(config: dict) -> list[str]:
    problems: list[str] = []
    for i, entry in enumerate(_need_list(problems, config, "patterns")):
        path = f"patterns.{i}"
        _need_text(problems, entry, path, "name", "regex", "format")
        if entry.get("type") not in V.PATTERN_TYPES:
            problems.append(f"{path}.type: must be one of {', '.join(V.PATTERN_TYPES)}")
        try:
            re.compile(entry.get("regex") or "")
        except re.error as error:
            problems.append(f"{path}.regex: {error}")
    words = config.get("abbreviations")
    if not isinstance(words, dict) or not all(isinstance(v, str) for v in words.values()):
        problems.append("abbreviations: a map of texts is required")
    return problems


def check_groups(config: dict) -> list[str]:
    problems: list[str] = []
    for i, entry in enumerate(_need_list(problems, config, "groups")):
        _need_text(problems, entry, f"groups.{i}", "base_name")
        if not entry.get("suffix") and not entry.get("keywords"):
            problems.append(f"groups.{i}: at least one of suffix or keywords must be provided")
    return problems


def _stop_on(problems: list[str], what: str) -> None:
    if problems:
        raise ConfigError(f"invalid {what}:\n" + "\n".join(f"  - {p}" for p in problems))


def _load(spark: SparkSession, path: str) -> dict:
    # One small file, read through Spark so that any file system works.
    text = spark.read.option("wholetext", True).text(path).first()
    if text is None:
        raise ConfigError(f"{path}: empty file")
    return json.loads(text[0])


def name_config(patterns: dict, groups: dict) -> NameConfig:
    _stop_on(check_patterns(patterns), "variation patterns")
    _stop_on(check_groups(groups), "product groups")
    return NameConfig(patterns["patterns"],
                      {k.lower(): v for k, v in patterns["abbreviations"].items()},
                      groups["groups"])


def location_config(spark: SparkSession, config: dict) -> DataFrame:
    _stop_on(check_locations(config), "locations")
    rows = [(i, e["name"], e["toast_id"], e["doordash_id"], e["square_id"])
            for i, e in enumerate(config["locations"])]
    return spark.createDataFrame(rows, LOCATION_DDL)


def read_config(spark: SparkSession, locations: str, patterns: str,
                groups: str) -> tuple[DataFrame, NameConfig]:
    return (location_config(spark, _load(spark, locations)),
            name_config(_load(spark, patterns), _load(spark, groups)))
