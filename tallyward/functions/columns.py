"""Scalar column functions. Paths are text or bytes; limits count bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of run modes and run states; any other name means `invalid`.
MODES = ("default", "full", "incremental")
STATES = ("nil", "initialised", "snapshot", "medasync", "workqueue", "cleanup", "finished", "aborting-medasync", "aborting-snapshot", "aborted")
MOST_PATH_BYTES = 4096


def percent_decode(c: Column, charset: str = "UTF-8") -> Column:
    """Bytes of a text (in the given charset) in which %XX stands for a byte; null where a % has no two hex digits behind it. A plus sign stays."""
    parts = F.split(c, "%", -1)
    piece = lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.unhex(F.substring(p, 1, 2)), F.encode(F.substring(p, 3, 1 << 30), charset)))
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.encode(parts[0], charset), lambda got, p: F.concat(got, piece(p)))


def clean_path(path: Column, mount: str, snapshot_dir: str, snapshot: str) -> Column:
    """The path below <mount>/<snapshot_dir>/<snapshot>, with a leading slash; null for a path that is not below it."""
    base = base_path(mount, snapshot_dir, snapshot)
    return F.when(path.startswith(base + "/"), F.substring(path, len(base) + 1, 1 << 30))


def base_path(*parts: str) -> str:
    """Path segments joined with single slashes, without one at the end."""
    joined = "/".join(p.strip("/") for p in parts if p.strip("/"))
    return ("/" if parts and parts[0].startswith("/") else "") + joined


def snapshot_path(path: Column, *base: str) -> Column:
    """Where a file of the table lies in a snapshot: the inverse of clean_path."""
    return F.regexp_replace(F.concat_ws("/", F.lit(base_path(*base)), path), "/{2,}", "/")


def short_enough(path: Column, most: int = MOST_PATH_BYTES) -> Column:
    return F.octet_length(path) <= most


def sha1_hex(content: Column) -> Column:
    return F.sha1(content)


def parse_state(name: Column) -> Column:
    return F.when(name.isin(*STATES), name).otherwise("invalid")


def parse_mode(name: Column) -> Column:
    return F.when(name.isin(*MODES), name).otherwise("invalid")


def uniform_rand(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone, so that runs repeat: the first 32 bits of their md5."""
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def per_changer_likelihood(p: Column) -> Column:
    """The likelihood of each of two independent changers that gives p for either of them."""
    return 1 - F.sqrt(1 - p)
