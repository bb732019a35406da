"""Scalar and aggregate number functions: rounding, ranks of percentiles, vectors, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    """``c`` within bounds; null stays null, which greatest and least alone would pass over."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def dot(a: Column, b: Column) -> Column:
    """The inner product; zero for vectors of different length."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x)


def percentiles(c: Column, at: Sequence[float] = (1, 5, 50, 90, 95, 99), digits: int = 2) -> Column:
    """A map p1, p5, ... of exact percentiles with linear interpolation."""
    values = F.percentile(c, F.array(*(F.lit(p / 100) for p in at)))
    return F.map_from_arrays(F.array(*(F.lit(f"p{p:g}") for p in at)), F.transform(values, lambda v: F.round(v, digits)))


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint32(text: Column) -> Column:
    """A 32-bit SimHash of CRC-32 values over words and single ideographs and the first 160 pairs of them.

    Longer texts are thinned to 320 tokens at even steps; a bit is set if at
    least half of the values have it. The votes of 32 bits are one numpy step a
    text, in Arrow batches; as lambdas they would be thousands of calls. Texts pass to
    Python whole, as lists of tokens cost more than the votes. No query goes by this
    sample of a text; records have ``whole_fingerprint32``.
    """

    @F.arrow_udf("bigint")
    def vote(texts: pa.Array) -> pa.Array:
        import re
        import zlib

        tokens, out = re.compile("[一-鿿]|[A-Za-z0-9]+"), []
        for whole in texts.to_pylist():
            words = tokens.findall(whole or "")
            kept = words[:: len(words) // 320][:320] if len(words) > 320 else words
            pairs = [a + b for a, b in zip(kept[:160], kept[1:161], strict=False)]
            values = np.array([zlib.crc32(w.encode()) for w in kept + pairs], "<u4")
            ones = np.unpackbits(values.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(axis=0)
            out.append(int(np.packbits(2 * ones >= len(values), bitorder="little").view("<u4")[0]))
        return pa.array(out, pa.int64())

    return vote(F.lower(text))


def whole_fingerprint32(text: Column) -> Column:
    """A 32-bit SimHash of CRC-32 values over all words and single ideographs of a text and all pairs of neighbours.

    A bit is set if at least half of the values have it. Texts pass to Python
    whole, as bytes, and vote in blocks of tokens: a long one takes no more memory than its bytes
    and a block. A pair's value goes on from that of its first token.
    """

    @F.arrow_udf("bigint")
    def vote(texts: pa.Array) -> pa.Array:
        import re
        from itertools import islice
        from zlib import crc32

        # U+4E00 to U+9FFF, the ideographs, in UTF-8
        tokens, out = re.compile(rb"\xe4[\xb8-\xbf][\x80-\xbf]|[\xe5-\xe9][\x80-\xbf]{2}|[A-Za-z0-9]+"), []
        for whole in texts.cast(pa.large_binary()).to_pylist():
            found, ones, n, last = tokens.finditer(whole or b""), np.zeros(32, np.int64), 0, []
            while block := [m[0] for m in islice(found, 1 << 16)]:
                single = [crc32(w) for w in block]
                before = last + single[:-1]
                values = np.array(single + [crc32(w, c) for w, c in zip(block[len(block) - len(before) :], before, strict=True)], "<u4")
                ones += np.unpackbits(values.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                n, last = n + len(values), single[-1:]
            out.append(int(np.packbits(2 * ones >= n, bitorder="little").view("<u4")[0]))
        return pa.array(out, pa.int64())

    return vote(F.lower(text))
