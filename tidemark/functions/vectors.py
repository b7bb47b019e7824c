"""Vector functions over ARRAY<FLOAT> columns; arithmetic is in doubles."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter of two vectors."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vector), F.lit(0.0), lambda s, x: s + x * x))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when either norm is 0."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def hyperplanes(dim: int, bits: int = 63, seed: int = 260118) -> list[list[float]]:
    """Normals of the signature planes: uniform on (-1, 1) from a seeded generator."""
    rng = random.Random(seed)
    return [[rng.uniform(-1.0, 1.0) for _ in range(dim)] for _ in range(bits)]


def lsh_signature(vector: Column, planes: Sequence[Sequence[float]]) -> Column:
    """Bit i is set where the product with plane i isn't negative.

    The planes are one nested literal of the plan, so nothing is joined.
    """
    table = F.array(*(literal(p) for p in planes))
    bits = F.transform(
        table, lambda p, i: F.when(dot(vector, p) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def lsh_bucket(signature: Column, bits: int = 16) -> Column:
    return signature.bitwiseAND((1 << bits) - 1).cast("int")


def _best_product(document: Column, query: Column) -> Column:
    return F.array_max(F.transform(document, lambda v: dot(v, query)))


def max_sim(document: Column, query: Sequence[Sequence[float]]) -> Column:
    """Late interaction: the best product of every query vector over its norm, 0 at least, averaged.

    The norm of document vectors isn't used.
    """
    best = []
    for q in query:
        length = sum(x * x for x in q) ** 0.5
        if length == 0:
            best.append(F.lit(0.0))
            continue
        top = _best_product(document, literal(q))
        best.append(F.greatest(F.coalesce(top / length, F.lit(0.0)), F.lit(0.0)))
    total = best[0]
    for x in best[1:]:
        total = total + x
    return total / len(query)


def centroid(vectors: Column, dim: int) -> Column:
    """Mean of an array of vectors."""
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, doubles(v), lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(vectors))


def sparse_token_id(token: Column) -> Column:
    """First four bytes of SHA-256, least significant first, as a number."""
    digest = F.sha2(token, 256)
    swapped = F.concat(*(F.substring(digest, i, 2) for i in (7, 5, 3, 1)))
    return F.conv(swapped, 16, 10).cast("long")


def byte_vector(text: Column, dim: int) -> Column:
    """Bytes of SHA-256 on [-1, 1], repeated to dim and normalised: a deterministic stand-in encoder."""
    digest = F.sha2(text, 256)
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1,
    )
    unit = F.transform(
        F.array(raw), lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))
    )
    return F.element_at(unit, 1)


def padded_bytes(text: Column, dim: int) -> Column:
    """Bytes of SHA-256 on [0, 1], zeros after the last one up to dim: the plain stand-in encoder."""
    shares = _byte_shares(F.sha2(text, 256), min(dim, 32))
    return F.concat(shares, F.array_repeat(F.lit(0.0), max(0, dim - 32)))


def counted_bytes(text: Column, dim: int) -> Column:
    """Bytes on [0, 1] of SHA-256 of the text's digest and a counter of two bytes, digest after digest, up to dim."""
    seed = F.unhex(F.sha2(text, 256))
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(max(0, -(-dim // 32) - 1))),
        lambda i: F.sha2(F.concat(seed, F.unhex(F.lpad(F.hex(i.cast("long")), 4, "0"))), 256),
    )
    return _byte_shares(F.array_join(blocks, ""), dim)


def _byte_shares(digits: Column, n: int) -> Column:
    """The first n bytes of hexadecimal digits over 255."""
    each = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(each, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)


def hash_score(query: str, document: Column) -> Column:
    """First byte of SHA-256 of query and document over 255: the stand-in reranker."""
    digest = F.sha2(F.concat(F.lit(f"{query}:"), F.coalesce(document, F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("double") / 255
