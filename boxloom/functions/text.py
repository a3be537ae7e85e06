"""Path, name and payload functions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_NEVER = "\x01"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot is not an extension."""
    return F.regexp_replace(base_name(path), r"(?s)^(.+)\.[^.]+$", "$1")


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]+)$", 1))


def match_key(path: Column) -> Column:
    """What survives exporters, folder prefixes and case: the lower base name."""
    return F.lower(base_name(F.regexp_replace(path, r"\\", "/")))


def folded_path(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("__"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def contains_like(text: Column, term: str) -> Column:
    """``LIKE '%term%'``: folds ASCII case only, wildcards in the term stay live."""
    pattern = "%" + term.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) + "%"
    return F.like(ascii_lower(text), F.lit(pattern), F.lit(_NEVER))


def safe_name(name: Column) -> Column:
    """One safe path component; null when nothing is left of it."""
    last = F.substring_index(F.regexp_replace(name, r"\\", "/"), "/", -1)
    clean = F.regexp_replace(last, r'[\x00-\x1f<>:"/\\|?*]', "_")
    trimmed = F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")
    return F.left(F.nullif(trimmed, F.lit("")), F.lit(255))


def safe_entry_name(name: Column) -> Column:
    """Archive entry name: runs of unsafe characters become one ``_``."""
    clean = F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]+', "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, r"^\.+", "_"), F.lit("")), F.lit("file"))


def folder_label(label: Column) -> Column:
    clean = F.regexp_replace(label, r"[^\p{L}\p{N} ._-]", "_")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def archive_label(name: Column) -> Column:
    clean = F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("dataset"))


def yaml_quote(name: Column) -> Column:
    escaped = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def class_hue(name: Column) -> Column:
    """Stable hue 0..359 of a class name: a rolling hash over its characters."""
    return F.aggregate(
        F.split(name, ""),
        F.lit(0),
        lambda hue, char: (hue * 31 + F.ascii(char)) % 360,
    )


def class_ids(text: Column) -> Column:
    """``"0, 2;5"`` to sorted distinct ids; null when nothing usable is left."""
    parts = F.transform(F.split(text, "[,;]"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    ids = F.transform(F.filter(parts, lambda p: p.rlike(r"^[+-]?[0-9]+$")), lambda p: p.try_cast("bigint"))
    kept = F.array_sort(F.array_distinct(F.filter(ids, lambda i: i.isNotNull())))
    return F.when(F.array_size(kept) > 0, kept)


def class_ids_browser(text: Column) -> Column:
    """The lenient variant: blanks separate too, prefixes count, negatives do not."""
    prefixes = F.transform(
        F.split(text, r"[,;\s]+"), lambda p: F.regexp_extract(p, r"^([+-]?[0-9]+)", 1)
    )
    ids = F.transform(prefixes, lambda p: p.try_cast("bigint"))
    kept = F.array_sort(F.array_distinct(F.filter(ids, lambda i: i >= 0)))
    return F.when(F.array_size(kept) > 0, kept)


def payload_text(payload: Column) -> Column:
    """The base64 part of a payload that may be a data URL."""
    cut = F.substring(payload, F.instr(payload, ",") + 1, 2**31 - 1)
    return F.when(
        payload.startswith("data:"), F.when(F.instr(payload, ",") > 0, cut).otherwise(F.lit(""))
    ).otherwise(payload)


def payload_bytes(payload: Column) -> Column:
    """Decoded bytes, null when the text is not base64."""
    return F.try_to_binary(payload_text(payload), F.lit("base64"))


def payload_error(payload: Column, max_bytes: int = 0) -> Column:
    """Why a payload cannot be used, null when it can."""
    text = payload_text(payload)
    reason = F.when(F.coalesce(payload, F.lit("")) == "", F.lit("missing image data"))
    if max_bytes:
        size = F.floor(F.length(text) * F.lit(3) / F.lit(4))
        reason = reason.when(size > max_bytes, F.lit(f"exceeds the {max_bytes // 2**20} MB limit"))
    return reason.when(payload_bytes(payload).isNull(), F.lit("malformed base64 data"))


def hash_bucket(path: Column) -> Column:
    """0..999, the same for a path in every run."""
    return F.conv(F.substring(F.md5(path.cast("binary")), 1, 8), 16, 10).cast("bigint") % 1000


def split_of(path: Column, val_fraction: float) -> Column:
    share = hash_bucket(path) / F.lit(1000.0)
    return F.when(share < val_fraction, F.lit("val")).otherwise(F.lit("train"))
