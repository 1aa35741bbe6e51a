"""Fingerprints, digests and reproducible draws as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.times import iso_utc


def stream_id(name: Column) -> Column:
    return F.sha2(name, 256)


def row_fingerprint(stream: Column, observed_at: Column, payload: Column) -> Column:
    """Identity of an observation: its stream, its instant and its canonical payload."""
    return F.sha2(
        F.concat_ws("|", stream, F.unix_micros(observed_at).cast("string"), payload), 256
    )


def content_digest(fingerprint: Column) -> Column:
    """Digest of a set of rows as one mergeable aggregate; row order does not matter."""
    head = F.conv(F.substring(fingerprint, 1, 15), 16, 10).cast("bigint")
    tail = F.conv(F.substring(fingerprint, 16, 15), 16, 10).cast("bigint")
    return F.sha2(
        F.concat_ws(
            "|",
            F.count(fingerprint).cast("string"),
            F.sum(head.cast("decimal(38,0)")).cast("string"),
            F.bit_xor(tail).cast("string"),
        ),
        256,
    )


def legacy_fingerprint(stream: Column, observed_at: Column, payload: Column) -> Column:
    """MD5 identity given to rows that were stored before fingerprints existed."""
    return F.md5(F.concat(stream, iso_utc(observed_at), payload))


def uniform(*parts: Column | str | int) -> Column:
    """A draw in [0, 1) that depends only on its arguments, on any partitioning."""
    text = F.concat_ws(
        "|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    )
    bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return bits / F.lit(4294967296.0)


def uniform_between(low: float, high: float, *parts: Column | str | int) -> Column:
    return F.lit(float(low)) + F.lit(float(high - low)) * uniform(*parts)


def gaussian(*parts: Column | str | int) -> Column:
    """A standard normal draw (Box-Muller) that depends only on its arguments."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - uniform("radius", *parts)))
    return radius * F.cos(F.lit(2.0) * F.pi() * uniform("angle", *parts))
