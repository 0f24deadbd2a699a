"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the polynomial hashes of all its prefixes, modulo two
primes. Any two spans are compared in constant time, and the longest common
extension of two positions is found by binary search. An edit that joins two
texts needs no new pass: its prefix hashes follow from the arrays of its parts.

The fingerprint of a text is its length, its whole hash and ``GRID`` hashes from its
prefix array. Likeness is the share of a text that longest common extensions with the
other cover: from both starts, back from both ends, and from where spans of ``SPAN`` code
points stand in the other text as well, looked for every ``STEP`` code points or less between, however
long the text is. Of a span that stands there several times the first and the last place count, and the one
where the match before it goes on; the longest extension to each side is taken. Each extension is found by binary search over the prefix arrays of both.

Documents are dealt by ranges of ids that Spark samples, and each meets the next in
its range; the last one of a range meets the first one of the next range in a second, small step.

Cases: null text is empty; two empty texts have likeness 1, an empty and another
0; repeated rows and equal ids follow one another ordered by a hash of their texts; a null id sorts
first; a single document is its own next; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import batches_of, filled, materialise, read

MODULI = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
GRID = 16
SPAN = 32
STEP = 32
RANGE_BYTES = 16 << 20
MIN_RANGES = 64
LEAST = -(2**63)


class Powers:
    """Powers of a base and of its inverse, grown as longer texts come."""

    def __init__(self, base: int, modulus: int):
        self.m = modulus
        self.up = self.down = np.ones(1, np.uint64)
        self.base, self.inverse = base, pow(base, -1, modulus)

    def grow(self, n: int) -> None:
        while len(self.up) <= n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, self.m)) % np.uint64(self.m)])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, self.m)) % np.uint64(self.m)])


POWERS = [Powers(b, m) for b, m in zip(BASES, MODULI)]


class Prefixes:
    """Prefix hashes of a text: ``sums[k][i]`` is the hash of the first ``i`` code points, before the modulus."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for p in POWERS:
            p.grow(self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * p.up[: self.n] % np.uint64(p.m), out=sums[1:])
            self.sums.append(sums)

    def prefix(self, ends: np.ndarray) -> list[np.ndarray]:
        return [s[ends] % np.uint64(p.m) for s, p in zip(self.sums, POWERS)]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Hashes of spans, the same wherever a span stands."""
        return [
            (b + np.uint64(p.m) - a) % np.uint64(p.m) * p.down[starts] % np.uint64(p.m)
            for a, b, p in zip(self.prefix(starts), self.prefix(ends), POWERS)
        ]

    def at(self, k: int, i: int) -> int:
        """Hash ``k`` of the first ``i`` code points."""
        return int(self.sums[k][i]) % MODULI[k]

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether the spans of a length at ``i`` here and at ``j`` there are the same."""
        for k, (m, p) in enumerate(zip(MODULI, POWERS)):
            one = (self.at(k, i + length) - self.at(k, i)) * int(p.up[j])
            two = (other.at(k, j + length) - other.at(k, j)) * int(p.up[i])
            if (one - two) % m:
                return False
        return True

    def common_extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common span that begins at ``i`` here and at ``j`` there."""
        return _longest(min(self.n - i, other.n - j), lambda length: self.equal(i, other, j, length))

    def common_ending(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common span that ends at ``i`` here and at ``j`` there."""
        return _longest(min(i, j), lambda length: self.equal(i - length, other, j - length, length))

    @cached_property
    def sliding(self) -> np.ndarray:
        """Hashes of all spans of SPAN code points."""
        starts = np.arange(max(0, self.n - SPAN + 1))
        return self.spans(starts, starts + SPAN)[0]


def _longest(most: int, same: Callable[[int], bool]) -> int:
    """The largest length up to ``most`` for which ``same`` holds, as it does for all smaller ones: doubling, then binary search."""
    low, high = 0, 1
    while high <= most and same(high):
        low, high = high, 2 * high
    high = min(high - 1, most)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if same(mid) else (low, mid - 1)
    return low


class Joined(Prefixes):
    """Prefix hashes of ``head[:keep] + tail[:take]`` from the arrays of both; no text is hashed again."""

    def __init__(self, head: Prefixes, keep: int, tail: Prefixes, take: int):
        self.head, self.keep, self.tail, self.n = head, keep, tail, keep + take
        for p in POWERS:
            p.grow(self.n + 1)

    def prefix(self, ends: np.ndarray) -> list[np.ndarray]:
        inside = np.minimum(ends, self.keep)
        beyond = ends - inside
        return [
            (a + b * p.up[self.keep]) % np.uint64(p.m)
            for a, b, p in zip(self.head.prefix(inside), self.tail.prefix(beyond), POWERS)
        ]

    def at(self, k: int, i: int) -> int:
        if i <= self.keep:
            return self.head.at(k, i)
        return (self.head.at(k, self.keep) + self.tail.at(k, i - self.keep) * int(POWERS[k].up[self.keep])) % MODULI[k]


class Fingerprint:
    """Length, whole hash, and 24-bit hashes of the prefixes at every multiple of a power-of-two stride."""

    def __init__(self, text: Prefixes):
        n = self.n = text.n
        stride = 1 << max(0, (-(-n // GRID) - 1).bit_length())
        one, two = text.prefix(np.arange(stride, n + 1, stride))
        self.grid = (one ^ (two >> np.uint64(7))) & np.uint64(0xFFFFFF)
        self.whole = f"{text.at(0, n):08x}{text.at(1, n):08x}"

    def __str__(self) -> str:
        grid = np.ascontiguousarray(self.grid.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]).tobytes()
        return f"{self.n}:{self.whole}:{base64.b64encode(grid).decode()}"


def likeness(a: Prefixes, b: Prefixes) -> float:
    """The share of ``a``, of the longer text, that common extensions with ``b`` cover; 1 for equal texts only."""
    if a.n == b.n and a.equal(0, b, 0, a.n):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    low = a.common_extension(0, b, 0)
    back = min(a.common_ending(a.n, b, b.n), min(a.n, b.n) - low)
    high = a.n - back
    covered = low + back
    if high - low >= SPAN <= b.n:
        places = np.unique(np.linspace(low, high - SPAN, 2 + (high - SPAN - low) // STEP).astype(np.int64))
        own = a.spans(places, places + SPAN)[0]
        size = np.uint64(1 << (64 * len(places)).bit_length())  # a filter with few false hits, in proportion to the spans sought
        slots = np.zeros(int(size), bool)
        slots[own % size] = True
        there = np.flatnonzero(slots[b.sliding % size])
        first = dict(zip(b.sliding[there[::-1]].tolist(), there[::-1].tolist()))
        last = dict(zip(b.sliding[there].tolist(), there.tolist()))
        shift = 0
        for i, span in zip(places.tolist(), own.tolist()):
            if i < low or span not in first:
                continue
            found = {first[span], last[span]}
            if len(found) == 2 and 0 <= i + shift < len(b.sliding) and b.sliding[i + shift] == span:
                found.add(i + shift)
            ahead, j = max((min(a.common_extension(i, b, j), high - i), j) for j in found)
            behind = max(min(a.common_ending(i, b, j), i - low) for j in found)
            covered += ahead + behind
            low, shift = i + ahead, j - i
    longest = max(a.n, b.n)
    return min(covered, longest - 1) / longest


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
OUT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: A range's rows, and its first and last document with their texts.
WALKED = OUT + ", kind int, range int, text string"
ROW, FIRST, LAST = 0, 1, 2


def _row(doc: tuple, following: tuple) -> tuple:
    doc_id, text, hashes = doc
    _, next_text, next_hashes = following
    n = hashes.n
    take = min(n // 2, next_hashes.n)
    edited = Joined(hashes, n - n // 2, next_hashes, take)
    digest = hashlib.sha256((text[: n - n // 2] + next_text[:take]).encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, digest, str(Fingerprint(hashes)), str(Fingerprint(edited)), likeness(hashes, edited), likeness(hashes, next_hashes)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range come in order, and each document meets the next."""
    names = [c.split()[0] for c in WALKED.split(", ")]
    kinds = [*OUT_TYPES, pa.int32(), pa.int32(), pa.string()]
    before, place = None, None

    def edge(kind: int, doc: tuple) -> tuple:
        return (doc[0], *[None] * 6, kind, place, doc[1])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    for batch in batches_of(batches, 500, 4 << 20, "text"):
        out = []
        for number, doc_id, text in zip(*(batch[c].to_pylist() for c in ("range", "doc_id", "text"))):
            doc = (doc_id, text, Prefixes(text))
            if before:
                out.append((*_row(before, doc), ROW, None, None))
            else:
                place = number
                out.append(edge(FIRST, doc))
            before = doc
        yield rows(out)
    if before:
        yield rows([edge(LAST, before)])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last document of a range with the first of the next one."""
    names = [c.split()[0] for c in OUT.split(", ")]
    for batch in batches_of(batches, 500, 4 << 20, "text"):
        columns = (batch[c].to_pylist() for c in ("doc_id", "text", "next_text"))
        out = [_row((doc_id, text, Prefixes(text)), (None, after, Prefixes(after))) for doc_id, text, after in zip(*columns)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), OUT_TYPES)], names)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document with its fingerprint, that of the text edited with the next document, and likenesses.

    The driver learns which ranges have documents: one number for each ``range_bytes`` of text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"))
    rows = rows.withColumns({"at": F.coalesce("doc_id", F.lit(LEAST)), "tie": F.xxhash64("text")})
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"] or 0
    ranges = max(MIN_RANGES, -(-total // range_bytes))
    ordered = rows.repartitionByRange(ranges, "at", "tie").sortWithinPartitions("at", "tie", "text")
    walked = ordered.select("doc_id", "text", F.spark_partition_id().alias("range")).mapInArrow(_walk, WALKED)
    walked = materialise(walked, "fingerprints")
    names = [c.split()[0] for c in OUT.split(", ")]
    firsts = walked.filter(F.col("kind") == FIRST).select(F.col("range").alias("following"), F.col("text").alias("next_text"))
    lasts = walked.filter(F.col("kind") == LAST).select("doc_id", "text", "range")
    used = sorted(r["following"] for r in firsts.select("following").collect())
    order = spark.createDataFrame(list(zip(used, used[1:] + used[:1])), "range int, following int")
    meet = lasts.join(order, "range").join(firsts, "following").select("doc_id", "text", "next_text").mapInArrow(_meet, OUT)
    return walked.filter(F.col("kind") == ROW).select(*names).unionByName(meet)


def op4_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(read(spark, sf_dir, "documents"))
