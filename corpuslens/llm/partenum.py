"""N-gram Jaccard self-join by PartEnum signatures, exact.

A document is the set of its distinct 5-word shingles; two documents link when
their sets have Jaccard similarity of 0.8 or more. Sizes fall into bands so that
linked sets lie in one band or in neighbouring ones, and each set takes part in
the windows of its own band and the next. Within a window linked sets differ in ``k``
elements at most (k = 2/9 of its largest size).

The domain of shingle hashes is cut into ``n1`` first-level partitions (``firsts``: k/2
and some more) and each of these into ``N2`` = 3 second-level ones. Differences in a first-
level partition exceed ``K2`` = 1 in k/2 of them at most; in any other, all
subsets of N2 - K2 second-level partitions are enumerated, and linked sets have equal
projections on one at least. A signature is the window, the first-level partition, the
subset and the hash of a projection. Empty projections are no signatures: a set has
enough first-level partitions with two non-empty parts, in which a difference leaves a
projection that isn't empty; a set with fewer of them (a short text, as a rule) has
tokens of its k + 1 + slack smallest shingles as well, which any two such sets share.

Linked sets share ``slack + 1`` signatures of a window, so each set drops its ``slack``
most frequent ones, in one order for all sets, without losing a pair: passages that
many documents share bring few groups. Of what remains, each signature group first
compares its members with one pivot (a star, never all pairs); then, with components
known, members outside a group's main component meet the members of other components, by
parity sketches that bound their difference from below: first the nearest member of
each component, then, with what is still apart, every member. What passes is
verified on whole sets of 64-bit shingle hashes.

Signatures are packed per bucket of signatures (some 6 bytes each here, up to 20 where
a map task has few for a bucket) and grouped by bucket; documents with equal sets are one
class throughout. The texts are read once for all sets and once more for candidates.

Cases: without words or text a set is empty and links with nothing, itself
included; with fewer than five words the whole sequence is the one shingle; equal
sets are one class; a repeated doc_id links the rows that have it, whatever their
texts; other columns are ignored; an empty table gives no rows. A row without an id
takes the component of documents with an equal set, if there are any (else null), and
brings no other links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import batches_of, filled, materialise, read
from corpuslens.operators.components import components

WORDS = 5
#: A second level of N2 partitions in each of the first; a signature is the projection on N2 - K2 of them.
N2, K2 = 3, 1
SUBSETS = [list(x) for x in itertools.combinations(range(N2), N2 - K2)]
#: Text bytes whose signatures a bucket's task reads, about.
BUCKET_BYTES = 24 << 20
MIN_BUCKETS = 32
#: Signatures that a map task holds before it sends them, and how many equal ones among them are sent apart.
FLUSH, HOT = 1_500_000, 64
FLAGS, HOT_MARK, HOT_N = 3, 4, 10**12
SALTS = 16
BLOCK = 2048
REMEMBERED = 300_000
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
U = np.uint64
OWN, NEXT, FINE, DOCUMENT = 0, 1, 2, 9  # flags: band of the set or the next one; tokens of single shingles; no signature


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(U)
    with np.errstate(over="ignore"):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> U(shift))) * U(factor)
        return x ^ (x >> U(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as longer pieces come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.r_[U(1), np.full(n, x, U)]) for x in (self.base, self.inverse))


POWERS = Powers(0x9E3779B97F4A7C15)
LETTERS = np.random.default_rng(11).integers(0, 2**64, 256, dtype=U)
BLANKS = b" \t\n\v\f\r"
IS_BLANK = np.isin(np.arange(256), list(BLANKS))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word: prefix sums of letters times powers give the hash of any span of bytes."""
    hashes, places, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):  # pieces end at blanks
            end = 1 + max(data.rfind(c, at, end) for c in BLANKS)
            if not end:
                end = min((x for c in BLANKS if (x := data.find(c, at + PIECE)) >= 0), default=len(data) - 1) + 1
        piece = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.ones(len(piece) + 2, bool)
        edge[1:-1] = IS_BLANK[piece]
        turns = np.flatnonzero(edge[1:] != edge[:-1])
        starts, ends = turns[::2], turns[1::2]
        POWERS.grow(len(piece))
        sums = np.zeros(len(piece) + 1, U)
        np.cumsum(LETTERS[piece] * POWERS.up[: len(piece)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * POWERS.down[starts] + (ends - starts).astype(U)))
        places.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The set of each text: sorted distinct 64-bit shingle hashes."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, places = word_hashes(b"\n".join(encoded).lower())
    ends = np.cumsum([len(x) + 1 for x in encoded])
    bounds = np.r_[0, np.searchsorted(places, ends)].tolist()

    def codes(h: np.ndarray, width: int) -> np.ndarray:
        out = np.full(max(0, len(h) - width + 1), width, U)
        for k in range(width):
            out = out * U(0x9E3779B97F4A7C15) + h[k : k + len(out)]
        return mix(out)

    with np.errstate(over="ignore"):
        windows = codes(hashes, WORDS)
        out = []
        for lo, hi in zip(bounds, bounds[1:]):
            own = np.sort(windows[lo : hi - WORDS + 1]) if hi - lo >= WORDS else codes(hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, U)
            if len(own) > 1:
                new = own[1:] != own[:-1]
                if not new.all():
                    own = own[np.r_[True, new]]
            out.append(own)
    return out


def shingles(text: str) -> np.ndarray:
    return shingle_sets([text])[0]


def set_key(values: np.ndarray) -> int:
    """Equal sets have equal keys; of 10^9 different sets two are taken for equal with a chance of 3 %."""
    return xxhash.xxh3_64_intdigest(values.tobytes())


def _bands() -> np.ndarray:
    """Smallest size of each band."""
    starts, low = [], 1
    while low < 2**40:
        starts.append(low)
        low = low * 5 // 4 + 1
    return np.array(starts, np.int64)


BANDS = _bands()


def differences(window: np.ndarray) -> np.ndarray:
    """k of a window: |x| + |y| - 2 |x and y| <= (|x| + |y|) / 9 where 100 |x and y| >= 80 |x or y|."""
    return (2 * (BANDS[window + 1] - 1)) // 9


def slack_of(k: np.ndarray) -> np.ndarray:
    return 1 + k // 24


def needed(k: np.ndarray) -> np.ndarray:
    """So many first-level partitions leave ``slack + 1`` with one difference at most: others have two or more."""
    return k // (K2 + 1) + 1 + slack_of(k)


def firsts(k: np.ndarray) -> np.ndarray:
    """n1 of a window: as many first-level partitions as are needed, and a fifth more, since some are nearly empty."""
    return -(-6 * needed(k) // 5)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, number of its set, flag) of non-empty sets."""
    none = (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.uint8))
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets) if sets else none[0]
    if not len(values):
        return none
    band = np.searchsorted(BANDS, sizes, side="right") - 1
    rank = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [none]
    with np.errstate(over="ignore"):
        mixed = mix(values + U(0x5851F42D4C957F2D))
        for flag in (OWN, NEXT):
            window = band + flag
            k = differences(window)
            n1 = np.where(k > 0, firsts(k), 0)  # without a difference sets are equal: one class
            seed = mix(window.astype(U) * U(2) + U(1))
            # Partitions are ranges of the hashed domain, so a sorted set comes by partition.
            begin = (np.cumsum(n1) - n1) * N2
            cell = begin[owner] + ((values >> U(32)) * (n1 * N2).astype(U)[owner] >> U(32)).astype(np.int64)
            use = (k > 0)[owner]
            own, cell = owner[use], cell[use]
            if not len(cell):
                continue
            at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            parts = np.zeros(int(n1.sum()) * N2, U)
            parts[cell[at]] = np.add.reduceat(mixed[use], at)
            parts = parts.reshape(-1, N2)
            full = parts != 0
            of = np.repeat(np.arange(len(sets)), n1)
            number = (np.arange(len(of)) - np.repeat(np.cumsum(n1) - n1, n1)).astype(U)
            for subset in SUBSETS:
                some = full[:, subset].any(axis=1)
                total = parts[some][:, subset].sum(axis=1, dtype=U)
                place = number[some] * U(len(SUBSETS)) + U(SUBSETS.index(subset))
                out.append((mix(mix(total + place) ^ seed[of[some]]), of[some], np.full(int(some.sum()), flag, np.uint8)))
            # Sets with too few partitions of two parts and more, which could share an empty projection only.
            rich = np.bincount(of[full.sum(axis=1) > K2], minlength=len(sets))
            thin = (rich < needed(k)) & (k > 0)
            fine = thin[owner] & (rank < (k + 1 + slack_of(k))[owner])
            o = owner[fine]
            out.append((mix(values[fine] ^ mix(seed[o] + U(FINE))), o, np.full(len(o), flag + FINE, np.uint8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(sig: np.ndarray, owner: np.ndarray, flag: np.ndarray, keys: np.ndarray, sizes: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes) of signatures: their sets' keys, sizes and counts, then 5 bytes for each signature and flag."""
    bucket = (sig & U(0xFFFFF)) % U(buckets)
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")  # owners ascend already
    short = ((sig >> U(20)) & U((1 << 37) - 1)) << U(3) | flag.astype(U)
    bucket, owner, short = bucket[order], owner[order], short[order]
    raw = short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    edges = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    for lo, hi in zip([0, *edges], [*edges, len(bucket)]):
        if hi > lo:
            o = owner[lo:hi]
            starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            own, counts = o[starts], np.diff(np.r_[starts, hi - lo]).astype("<u4")
            table = keys[own].astype("<u8").tobytes() + sizes[own].astype("<u4").tobytes() + counts.tobytes()
            yield int(bucket[lo]), b"".join([len(own).to_bytes(4, "little"), table, raw[lo:hi].tobytes()])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature within the bucket, flag, key, size of the set)."""
    n = int.from_bytes(data[:4], "little")
    keys = np.frombuffer(data, "<u8", n, 4)
    sizes = np.frombuffer(data, "<u4", n, 4 + 8 * n)
    counts = np.frombuffer(data, "<u4", n, 4 + 12 * n)
    raw = np.frombuffer(data, np.uint8, offset=4 + 16 * n).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    short = wide.view("<u8")[:, 0]
    return short >> U(3), (short & U(7)).astype(np.uint8), np.repeat(keys, counts), np.repeat(sizes, counts)


SHARED = "sig long, flag int, key long, n_shingles long, n long, doc_id long"


def shared_signatures(docs: DataFrame) -> DataFrame:
    """One pass over the texts, written once: documents, and signatures that two or more sets have.

    A document's row has flag ``DOCUMENT``, its doc_id, the key and size of its set. A
    signature's row has the number ``n`` of sets with it. A signature that many sets
    of one map task have, a common passage say, goes to ``SALTS`` groups in place of one,
    counts as ``HOT_N`` for all its sets, and leaves one set with a mark in its bucket.
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    buckets = max(MIN_BUCKETS, -(-total // BUCKET_BYTES))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        keys: list[int] = []
        sizes: list[int] = []
        turn = 0

        def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "salt", "data"])

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                sig, owner, flag = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(owner, kind="stable")
                sig, owner, flag = sig[order], owner[order], flag[order]
                both = np.array(keys, U), np.array(sizes, np.int64)
                ordered = np.sort(sig)
                hot = ordered[HOT - 1 :][ordered[HOT - 1 :] == ordered[: len(ordered) - HOT + 1]]
                if len(hot):
                    hot = np.unique(hot)
                    many = np.isin(sig, hot)
                    h_sig, h_owner, h_flag = sig[many], owner[many], flag[many]
                    first = np.unique(h_sig, return_index=True)[1]
                    for b, data in _pack(h_sig, h_owner, h_flag, *both, buckets):
                        yield rows([(b, 1 + turn % SALTS, data)])
                    flag = flag.copy()
                    flag[np.flatnonzero(many)[first]] |= HOT_MARK
                    keep = ~many | (flag & HOT_MARK > 0)
                    sig, owner, flag = sig[keep], owner[keep], flag[keep]
                for b, data in _pack(sig, owner, flag, *both, buckets):
                    yield rows([(b, 0, data)])
            held.clear()
            keys.clear()
            sizes.clear()

        for batch in batches_of(batches, 1000, PIECE, "text"):
            sets = shingle_sets(batch["text"].to_pylist())
            own = np.array([set_key(s) for s in sets], U)
            ids = batch["doc_id"]
            known = np.asarray(ids.is_valid(), np.uint8)
            packed = [np.array([len(s) for s in sets], "<i8"), own.astype("<u8"), ids.fill_null(0).to_numpy().astype("<i8"), known]
            turn += 1
            yield rows([(-1, int(own[0] % U(buckets)), b"".join(x.tobytes() for x in packed))])
            fresh = []
            first = len(keys)
            for key, values in zip(own.tolist(), sets):
                if len(values) and key not in seen:  # equal sets need their signatures once; what is forgotten is only sent again
                    if len(seen) < REMEMBERED:
                        seen.add(key)
                    fresh.append(values)
                    keys.append(key)
                    sizes.append(len(values))
            if fresh:
                sig, owner, flag = signatures(fresh)
                held.append((sig, owner + first, flag))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield from flush()
        yield from flush()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bucket, salt = [], 0, 0
        for batch in batches:
            for b, t, data in zip(batch["bucket"].to_pylist(), batch["salt"].to_pylist(), batch["data"]):
                bucket, salt = b, t
                if bucket < 0:
                    yield documents(data.as_py())
                else:
                    parts.append(_unpack(data.as_py()))
        if parts:
            columns = tuple(np.concatenate(x) for x in zip(*parts))
            parts.clear()
            yield from shared(*columns, bucket, salt > 0)

    def documents(data: bytes) -> pa.RecordBatch:
        n = len(data) // 25
        size, key, doc_id = (np.frombuffer(data, "<i8", n, 8 * n * i) for i in range(3))
        known = np.frombuffer(data, np.uint8, n, 24 * n) > 0
        none = pa.nulls(n, pa.int64())
        return out(none, np.full(n, DOCUMENT), key, size, none, pa.array(doc_id, mask=~known))

    def shared(sig: np.ndarray, flag: np.ndarray, key: np.ndarray, size: np.ndarray, bucket: int, hot: bool) -> Iterator[pa.RecordBatch]:
        if not hot:
            order = np.argsort(sig)
            ordered = sig[order]
            same = ordered[1:] == ordered[:-1]
            several = order[np.r_[False, same] | np.r_[same, False]]
            sig, flag, key, size = sig[several], flag[several], key[several], size[several]
        # Own and next band meet in one signature; single-shingle tokens are apart by their hash already.
        order = np.lexsort((flag, key, sig))
        sig, flag, key, size = sig[order], flag[order], key[order], size[order]
        number = np.cumsum(np.r_[True, sig[1:] != sig[:-1]]) - 1 if len(sig) else np.zeros(0, np.int64)
        marked = np.bincount(number, flag & HOT_MARK) > 0
        first = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])] if len(sig) else np.zeros(0, bool)
        sig, flag, key, size, number = sig[first], flag[first], key[first], size[first], number[first]
        n = np.where(marked, HOT_N, np.bincount(number, minlength=len(marked)))[number]
        n = np.full(len(n), HOT_N) if hot else n
        keep = n > 1
        full = (sig[keep].astype(np.int64) << 20) | (bucket & 0xFFFFF)
        table = pa.Table.from_batches([out(full, flag[keep] & FLAGS, key[keep].view(np.int64), size[keep], n[keep], pa.nulls(int(keep.sum()), pa.int64()))])
        yield from table.to_batches(max_chunksize=20_000)

    def out(*columns) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        arrays = [c if isinstance(c, pa.Array) else pa.array(np.asarray(c).astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SHARED.split(", ")])

    packed = docs.mapInArrow(emit, "bucket long, salt int, data binary")
    return materialise(packed.groupBy("bucket", "salt").applyInArrow(group, SHARED), "shared-signatures")


def trimmed(shared: DataFrame) -> DataFrame:
    """(sig, key, pivot, n) without each set's ``slack`` most frequent signatures of a kind, and without groups of one.

    The slack follows from the size of the set.
    """
    bands = F.array(*[F.lit(int(b)) for b in BANDS])
    ends = F.element_at(bands, F.size(F.filter(bands, lambda b: b <= F.col("n_shingles"))) + 1 + F.col("flag") % 2) - 1
    k = F.floor(2 * ends / 9)
    slack = 1 + F.floor(k / 24)
    slack = F.when(F.col("flag") >= FINE, F.greatest(F.lit(0), F.least(F.col("n_shingles") - k - 1, slack))).otherwise(slack)
    most = Window.partitionBy("key", "flag").orderBy(F.desc("n"), F.desc("sig"))
    kept = shared.withColumn("rank", F.row_number().over(most)).filter(F.col("rank") > slack).select("sig", "key")
    kept = materialise(kept.distinct(), "kept-signatures")
    groups = kept.groupBy("sig").agg(F.count("*").alias("n"), F.min("key").alias("pivot")).filter("n > 1")
    return materialise(kept.join(groups, "sig"), "candidate-groups")


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches differ in no more cells than linked sets may in elements."""
    for batch in batches:
        sizes = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
        differ = [int(np.bitwise_count(x[0] ^ x[1]).sum()) for x in (_folded(list(two)) for two in zip(batch["sketch_a"].to_pylist(), batch["sketch_b"].to_pylist()))]
        keep = pa.array(9 * np.array(differ, np.int64) <= sizes)
        yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets link; sets move only for pairs that their sketches allow."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("values").alias("in_a"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("values").alias("in_b"))
    sized = sets.select("key", "n", "sketch")
    fit = (
        pairs.join(sized.toDF("a", "n_a", "sketch_a"), "a")
        .join(sized.toDF("b", "n_b", "sketch_b"), "b")
        .filter(5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
        .mapInArrow(_screened, "a long, b long")
    )
    both = fit.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("in_a", "in_b"))
    return both.filter(100 * common >= 80 * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"))
    found = shared_signatures(rows)
    members = found.filter(F.col("flag") == DOCUMENT).select("doc_id", "n_shingles", "key")
    classes = members.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    classes = materialise(classes, "classes")
    groups = trimmed(found.filter(F.col("flag") < DOCUMENT))
    wanted = groups.select("key").distinct().join(classes, "key").filter("first is not null").select("key", "first")
    sets = materialise(_sets(rows, wanted), "sets")
    star = groups.filter("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    links = verified(star, sets)
    # A doc_id with several texts ties them.
    texts = members.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "key").distinct()
    several = texts.groupBy("doc_id").agg(F.min("key").alias("a"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "a")
    links = links.unionByName(texts.join(several, "doc_id").filter("key <> a").select("a", F.col("key").alias("b")))
    labels = components(materialise(links, "star-links").toDF("u", "v"))
    # Nearest pairs first: one link joins a member to a component, whatever number it has. The second round leaves nothing out.
    for nearest in (True, False):
        rest = materialise(unresolved(groups, labels, sets, nearest), "other-pairs")
        if rest.isEmpty():
            if nearest:
                break  # no pair at all passes
            continue
        more = materialise(verified(rest, sets), "more-links")
        if not more.isEmpty():
            labels = relabelled(labels, more)
    return _answers(members, classes, labels)


def _answers(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """The smallest doc_id of each document's component. A set that very many documents have is dealt over SALTS keys."""
    labelled = classes.join(labels.toDF("key", "component"), "key", "left")
    own = labelled.filter("component is null and copies > 1").select("key", F.col("first").alias("component_id"))
    joined = materialise(labelled.filter("component is not null").select("key", "first", "component"), "labelled-classes")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    answers = own.unionByName(joined.join(least, "component").select("key", "component_id"))
    dealt = answers.select("key", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(dealt, ["key", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def parity_sketch(values: np.ndarray) -> bytes:
    """One bit per cell of a power-of-two table: whether the set has an odd number of elements there.

    Two sketches differ in no more cells than their sets differ in elements. A
    sketch of twice the cells folds onto a smaller one by xor of its halves.
    """
    cells = 1 << max(8, (32 * len(values) // 9).bit_length())  # sixteen times k or more: few pairs pass that do not link
    odd = np.bincount((values >> U(11)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of 64-bit words, all of the smallest size among them."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), np.uint64)
    for i, sketch in enumerate(sketches):
        words = np.frombuffer(sketch, np.uint64)
        while len(words) > out.shape[1]:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        out[i] = words
    return out


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, n, values, sketch) of the classes wanted, from the text of their first document; texts stream past a hash table of ids."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a row may be repeated, and its doc_id may have other texts
        for batch in batches_of(batches, 1000, PIECE, "text"):
            keys, sets = [], []
            for key, values in zip(batch["key"].to_pylist(), shingle_sets(batch["text"].to_pylist())):
                if key not in seen and int(np.array(set_key(values), U).view(np.int64)) == key:
                    seen.add(key)
                    keys.append(key)
                    sets.append(values)
            values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            columns = [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), values, pa.array([parity_sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "values", "sketch"])

    hits = rows.join(wanted.hint("shuffle_hash"), rows["doc_id"] == wanted["first"]).select("key", "text")
    return hits.mapInArrow(build, "key long, n long, values array<long>, sketch binary")


def unresolved(groups: DataFrame, labels: DataFrame, sets: DataFrame, nearest: bool = False) -> DataFrame:
    """Pairs in one signature group, in different components and not yet compared, that their sketches allow to link.

    Groups of equal members count once. In a group, the members outside its main
    component meet all others, by tiles of BLOCK x BLOCK members whose sketches one
    task compares in memory; only pairs that pass become rows.
    """
    named = groups.join(labels.toDF("key", "label"), "key", "left").select(
        "sig", "key", "pivot", F.coalesce("label", "key").alias("label")
    )
    named = materialise(named, "labelled-groups")
    marks = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    mixed = named.groupBy("sig").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), *marks)
    # In groups of two the pivot has met the other one.
    mixed = mixed.filter("low <> high and n > 2").groupBy("n", "m1", "m2").agg(F.min("sig").alias("sig")).select("sig", "n")
    open_rows = materialise(named.join(mixed, "sig"), "open-groups")
    main = (
        open_rows.groupBy("sig", "label")
        .agg(F.count("*").alias("size"))
        .groupBy("sig")
        .agg(F.max_by(F.struct("label", "size"), F.struct("size", "label")).alias("main"))
        .select("sig", F.col("main.label").alias("main"), F.col("main.size").alias("main_size"))
    )
    rows = open_rows.join(main, "sig").join(sets.select("key", F.col("n").alias("size"), "sketch"), "key")
    # Tiles: an outsider goes to one row of tiles and is a member in one column; a member of the main component only in its column.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    out_blocks = F.ceil((F.col("n") - F.col("main_size")) / BLOCK).cast("int")
    row, column = F.pmod(F.xxhash64("key"), out_blocks).cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), blocks).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    as_member = F.transform(upto(out_blocks), lambda i: F.struct(i.alias("i"), column.alias("j"), F.lit(False).alias("asks")))
    as_asker = F.transform(upto(blocks), lambda j: F.struct(row.alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    places = F.when(F.col("label") == F.col("main"), as_member).otherwise(F.concat(as_member, as_asker))
    dealt = rows.select("sig", "key", "label", "pivot", "size", "sketch", F.explode(places).alias("p"))
    tiles = dealt.select("sig", "p.i", "p.j", "p.asks", "key", "label", "pivot", "size", "sketch")
    ordered = tiles.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return ordered.mapInArrow(_nearest_pairs if nearest else _tile_pairs, "a long, b long").distinct()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more links: components are joined, not nodes."""
    ends = links.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    merged = components(ends.select(F.coalesce("la", "a").alias("u"), F.coalesce("lb", "b").alias("v")))
    old = labels.join(merged.toDF("component", "joined"), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    new = merged.join(labels.select("node"), "node", "left_anti")
    return materialise(old.unionByName(new), "labels")


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a tile that pass."""
    yield from _tiles(batches, False)


def _nearest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each asker and other component, the member with the nearest sketch, if it passes."""
    yield from _tiles(batches, True)


def _tiles(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    names = ["sig", "i", "j"]

    def pairs(tile: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
        asks = tile["asks"].to_numpy(zero_copy_only=False)
        ids, labels, sizes = (tile[c].to_numpy() for c in ("key", "label", "size"))
        pivot = tile["pivot"][0].as_py()
        words = _folded(tile["sketch"].to_pylist())
        members = np.flatnonzero(~asks & (ids != pivot))
        left, right = [], []
        for k in np.flatnonzero(asks & (ids != pivot)):
            far = members[labels[members] != labels[k]]
            both = sizes[far] + sizes[k]
            differ = np.bitwise_count(words[far] ^ words[k]).sum(axis=1, dtype=np.int64)
            passed = 9 * differ <= both
            far, differ = far[passed], differ[passed]
            if nearest and len(far):
                order = np.lexsort((ids[far], differ, labels[far]))
                far = far[order]
                far = far[np.r_[True, labels[far][1:] != labels[far][:-1]]]
            left.append(np.minimum(ids[far], ids[k]))
            right.append(np.maximum(ids[far], ids[k]))
        none = [np.zeros(0, np.int64)]
        return np.concatenate(left or none), np.concatenate(right or none)

    def finish(table: pa.Table) -> pa.RecordBatch:
        keys = np.column_stack([table[c].to_numpy() for c in names])
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        found = [pairs(table.slice(lo, hi - lo)) for lo, hi in zip([0, *edges], [*edges, len(keys)])]
        a, b = (np.concatenate(x) for x in zip(*found))
        both = np.unique(np.column_stack([a, b]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = [table[c][-1].as_py() for c in names]
        own = np.ones(table.num_rows, bool)
        for c, x in zip(names, last):
            own &= table[c].to_numpy() == x
        start = table.num_rows - int(own[::-1].argmin() if not own.all() else table.num_rows)
        if start:  # the last tile may go on in the next batch
            yield finish(table.slice(0, start))
        held = table.slice(start).combine_chunks().to_batches()
    if held:
        yield finish(pa.Table.from_batches(held))


def op10_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"))
