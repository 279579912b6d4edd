"""Masking of personal data with regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_of, let

#: Fixed values: (placeholder, pattern) of the combined masker, in the order in which they apply.
MASKS = [
    ("<EMAIL>", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("<PHONE>", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"),
    ("<CREDIT_CARD>", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("<SSN>", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("<IP_ADDRESS>", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
]
#: The separate maskers that also count.
EMAILS = ("|||EMAIL_ADDRESS|||", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")
PHONES = ("|||PHONE_NUMBER|||", r"\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4}")
IPS = ("|||IP_ADDRESS|||", r"\b(?:\d{1,3}\.){3}\d{1,3}\b")


def mask_pii(text: Column) -> Column:
    for placeholder, pattern in MASKS:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def _counted(text: Column, rule: tuple[str, str]) -> Column:
    return F.struct(F.regexp_replace(text, rule[1], rule[0]).alias("text"), F.regexp_count(text, F.lit(rule[1])).alias("n"))


def mask_emails(text: Column) -> Column:
    return _counted(text, EMAILS)


def mask_phone_numbers(text: Column) -> Column:
    return _counted(text, PHONES)


def mask_ips(text: Column) -> Column:
    return _counted(text, IPS)


def masks_made(text: Column, masked: Column) -> Column:
    """Replacements that mask_pii made, counted by the placeholders that it added."""
    return sum(count_of(masked, p) - count_of(text, p) for p, _ in MASKS).cast("long")


def pii_counts(text: Column) -> Column:
    """Replacements made by mask_pii."""
    return let(text, lambda t: let(mask_pii(t), lambda m: masks_made(t, m)))
