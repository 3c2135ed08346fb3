"""Account names from YAML, and the library's configuration. Small files, read on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..model import ACCOUNT

CONFIG_PLACES = ["tally.json", "config/tally.json", "tally.yaml", "config/tally.yaml"]
PARSERS = {"qfx", "csv", "pdf"}


def parse_accounts(content: str) -> tuple[bool, list[tuple]]:
    """Whether the YAML is fine, and rows of ACCOUNT. Nothing is fine and empty; bad YAML, or one that isn't a mapping, is not.
    Accounts without name are left out, other types than debit and credit are debit, the last of equal keys counts."""
    try:
        tree = yaml.safe_load(content)
    except yaml.YAMLError:
        return False, []
    if tree is None:
        return True, []
    if not isinstance(tree, dict):
        return False, []
    out = {}
    for institution, accounts in tree.items():
        for account_id, about in accounts.items() if isinstance(accounts, dict) else ():
            if not isinstance(about, dict) or not about.get("account_name"):
                continue
            kind = str(about.get("account_type") or "").lower()
            key = (str(institution).lower(), str(account_id))
            out[key] = (*key, str(about["account_name"]), kind if kind in ("debit", "credit") else "debit", about.get("description"))
    return True, list(out.values())


def accounts(spark: SparkSession, path: str) -> tuple[bool, DataFrame]:
    """parse_accounts of a file as a table; a missing file is fine and empty. The file is read by Spark, so any of its stores will do."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    fine, found = parse_accounts(rows[0]["value"]) if rows else (True, [])
    return fine, spark.createDataFrame(found, ACCOUNT)


@dataclass
class Config:
    raw_directory: str = "raw"
    data_directory: str = "data"
    skip_processed: bool = True
    force_reprocess: bool = False
    date_formats: list[str] = field(default_factory=list)
    column_overrides: dict[str, str] = field(default_factory=dict)
    institution_mappings: dict[str, str] = field(default_factory=dict)
    institutions: dict[str, dict] = field(default_factory=dict)

    def problems(self) -> list[str]:
        wrong = [f"{f.name} must be {type(f.default_factory() if callable(f.default_factory) else f.default).__name__}" for f in fields(self) if not isinstance(getattr(self, f.name), type(f.default_factory() if callable(f.default_factory) else f.default))]
        for name, about in self.institutions.items() if isinstance(self.institutions, dict) else ():
            if not isinstance(about, dict) or about.get("parser_type") not in PARSERS:
                wrong.append(f"institution {name}: parser_type must be one of {', '.join(sorted(PARSERS))}")
        return wrong


    def updated(self, **changes: object) -> tuple[Config, list[str]]:
        """This configuration with changes, and what is wrong with them: unknown names are left out; if a value is wrong, nothing changes. Config() has the defaults."""
        known = {f.name for f in fields(self)}
        wrong = [f"unknown setting {name}" for name in changes if name not in known]
        new = replace(self, **{k: v for k, v in changes.items() if k in known})
        bad = new.problems()
        return (self if bad else new), wrong + bad

    def of_institution(self, name: str) -> dict | None:
        """The settings of an institution, whatever the case of its name."""
        return next((about for n, about in self.institutions.items() if n.lower() == name.lower()), None)


def load_config(path: str | None = None) -> tuple[Config, list[str]]:
    """The configuration and its problems; any problem gives the defaults."""
    path = path or next((p for p in CONFIG_PLACES if os.path.exists(p)), None)
    if not path or not os.path.exists(path):
        return Config(), []
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f) if path.endswith(".json") else yaml.safe_load(f) or {}
        config = Config(**{k: v for k, v in raw.items() if k in {x.name for x in fields(Config)}})
    except (ValueError, TypeError, AttributeError, yaml.YAMLError) as e:
        return Config(), [str(e)]
    wrong = config.problems()
    return (Config(), wrong) if wrong else (config, [])
