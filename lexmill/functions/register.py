"""The text functions under their names in SQL, as expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .pii import EMAILS, IPS, MASKS, PHONES
from .quality import NSFW_PKG, NSFW_STRICT, TOXIC_PKG, TOXIC_STRICT
from .text import SCRIPTS


def _s(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else 'r"' + value + '"'


def _any(keys: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(t), {_s(k)})" for k in keys) + ")"


def definitions() -> dict[str, tuple[str, str]]:
    """Name: (type, expression over the text t)."""
    masked = "t"
    for placeholder, pattern in MASKS:
        masked = f"regexp_replace({masked}, {_s(pattern)}, '{placeholder}')"
    counted = lambda rule: f"named_struct('text', regexp_replace(t, {_s(rule[1])}, '{rule[0]}'), 'n', regexp_count(t, {_s(rule[1])}))"
    hits = "(" + " + ".join(f"int(contains(lower(t), {_s(k)}))" for k in TOXIC_STRICT) + ")"
    kind = "STRUCT<label: STRING, score: DOUBLE>"
    out = {
        "mask_pii": ("STRING", masked),
        "nsfw_pkg": ("BOOLEAN", _any(NSFW_PKG)),
        "toxic_pkg": ("BOOLEAN", _any(TOXIC_PKG)),
        "nsfw_strict": (kind, f"named_struct('label', if({_any(NSFW_STRICT)}, 'nsfw', 'non-nsfw'), 'score', 1.0D)"),
        "toxic_strict": (kind, f"named_struct('label', if({hits} >= 2, 'toxic', 'non-toxic'), 'score', if({hits} >= 2, double({hits}), 1.0D))"),
        "script_language": ("STRING", "CASE " + " ".join(f"WHEN t RLIKE {_s(ranges)} THEN '{lang}'" for lang, ranges in SCRIPTS) + " ELSE 'en' END"),
    }
    for name, rule in (("mask_emails", EMAILS), ("mask_phone_numbers", PHONES), ("mask_ips", IPS)):
        out[name] = ("STRUCT<text: STRING, n: INT>", counted(rule))
    return out


def register(spark: SparkSession) -> list[str]:
    """Make all of them temporary SQL functions of the session."""
    for name, (kind, expression) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {expression}")
    return sorted(definitions())
