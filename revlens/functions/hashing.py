"""Digest expressions for identities and content checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\x1f"
NULL_SEPARATOR = "\x00"
PACKED = "_target"


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def short_digest(text: Column, width: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, width)


def joined_digest(parts: list[Column], separator: str, width: int = 24) -> Column:
    """Leading hex digits of the digest of ``parts`` joined by ``separator``."""
    return short_digest(F.concat_ws(separator, *parts), width)


def repository_id(remote: Column) -> Column:
    return short_digest(remote, 16)


def sample_id(repository: Column, path: Column) -> Column:
    return joined_digest([repository, path], ":", 20)


def node_id(*parts: Column) -> Column:
    return joined_digest(list(parts), NULL_SEPARATOR)


def symbol_id(path: Column, qualified_name: Column, kind: Column) -> Column:
    return joined_digest([path, qualified_name, kind], NULL_SEPARATOR)


def snapshot_id(repository: Column, head_sha: Column, tree_hash: Column, diff_hash: Column) -> Column:
    """Identity of a code state; a clean tree has no diff hash."""
    return F.concat(
        F.lit("snap_"),
        joined_digest(
            [repository, head_sha, tree_hash, F.coalesce(diff_hash, F.lit("clean"))], UNIT_SEPARATOR
        ),
    )


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; nested structs must already be alphabetic."""
    return F.to_json(
        F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"}
    )


def canonical_text(text: Column) -> Column:
    """Any JSON text as compact JSON with sorted keys at every level; null where it is no JSON.

    Numbers take their shortest form, so 1.50 becomes 1.5 and 1.0 becomes 1.
    """
    return F.to_json(F.try_parse_json(text))


def key_digest(keys: Sequence[str]) -> Column:
    """128 bits of some columns as bytes; null where one of them is, so that it joins like the columns themselves."""
    texts = [F.col(name).cast("string") for name in keys]
    sized = [part for text in texts for part in (F.length(text).cast("string"), F.lit(":"), text)]
    return F.unhex(short_digest(F.concat(*sized), 32))


def pack(df: DataFrame, keys: Sequence[str], name: str = PACKED) -> DataFrame:
    """Replace the key columns by one digest: three text keys would be most of what a shuffle of short rows carries."""
    return df.select(key_digest(keys).alias(name), *[column for column in df.columns if column not in keys])


def unpack(df: DataFrame, known: DataFrame, keys: Sequence[str], name: str = PACKED) -> DataFrame:
    """Give packed rows their key columns back from ``known``; key columns nobody reads are not shuffled."""
    named = known.select(key_digest(keys).alias(name), *keys).groupBy(name).agg(*[F.any_value(key).alias(key) for key in keys])
    return df.join(named, name).select(*keys, *[column for column in df.columns if column != name])
