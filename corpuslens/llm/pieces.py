"""SentencePiece encoding with N-best segmentation, and decoding.

Over the lattice of vocabulary pieces, forward Viterbi scores give each node the
best score from the start. A backward A* search from the end uses them as exact
heuristics, so paths come out best first and none is opened in vain: a path taken
from the heap goes straight on to the start along Viterbi edges, which lose nothing,
and what it passes by goes into the heap with what it would lose.

No piece holds a space mark after another character, so a text's lattice falls apart
before each run of spaces (and around line feeds). For each unit the search gives its
best path and the loss of its second best, both remembered; only the N - 1 units of a
text where a change is cheapest are searched to N paths, since a text's N best are
the N smallest sums of losses over its units.

The score of a path is the sum of the model's piece scores (ranks here, so whole
numbers). A character without a piece costs ``UNKNOWN`` less than the lowest score
and is spelled in byte pieces; so is a space mark in the text itself, which keeps
decoding exact. The best path of a unit takes the smaller piece ids on ties; which of
further paths with equal scores are taken follows a fixed order of the search.

Cases: null text is empty and has one segmentation without pieces; a text with
fewer than N segmentations gives them all; repeated rows get equal results; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import batches_of, filled, read

MODEL = "piece_bpe_32k.model"
NBEST = 4
MARK = "▁"
UNKNOWN = 10
#: Units remembered in a Python worker at most (some 200 MB), and those searched to N paths.
REMEMBERED = 800_000
SEARCHED = 100_000
#: Ids of remembered units at most; N best paths are remembered of units up to so many characters.
POOL = 8_000_000
LONG = 16
LOWEST = -(10**15)
NO_PATH = 10**15
UNITS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Stands for a space mark in the text itself; a lone surrogate is in no valid text.
OWN_MARK = "\ud800"

Path = tuple[int, tuple[int, ...]]


class Lattice(dict):
    """unit -> its row in the columns ``scores``, ``losses`` (of the second best path), ``ends`` (of the best path's ids in ``pool``)."""

    def __init__(self, path: str, nbest: int = NBEST):
        super().__init__()
        self.nbest = nbest
        self.scores, self.losses, self.ends, self.pool = array("q"), array("q"), array("q", [0]), array("I")
        self.searched: dict[str, list[tuple[int, bytes]]] = {}
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (i, int(model.get_score(i))) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.spelled = {i: p.replace(MARK, " ").encode() for p, (i, _) in self.pieces.items()}
        self.spelled |= {i: bytes([b]) for b, i in self.bytes.items()}
        normal = [s for _, s in self.pieces.values() if s > -1_000_000]
        self.unknown = min(normal, default=0) - UNKNOWN
        if any(MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1 for p in self.pieces):
            raise ValueError("a piece holds a space after another character; units can't be cut there")
        #: Pairs of characters inside pieces; between any other two a lattice falls apart.
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.singles = {p for p in self.pieces if len(p) == 1}
        #: Finds all pieces in a unit, by their ends.
        self.finder = ahocorasick.Automaton()
        for p, (i, score) in self.pieces.items():
            self.finder.add_word(p, (len(p), score, (i,)))
        self.finder.make_automaton()
        #: The spelling of each id, end to end, and where it begins and how long it is.
        spelled = [self.spelled.get(i, b"") for i in range(size)]
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def forward(self, unit: str) -> tuple[list[int], list, list[list]]:
        """Viterbi scores from the start to each node, the edge that each came by, and all edges into each node.

        An edge is (start node, score, ids). Every character has an edge of its own. Of
        equal scores the smaller ids win: no path's ids begin with all of another's.
        """
        n = len(unit)
        best, back = [0] * (n + 1), [None] * (n + 1)
        into: list[list] = [[] for _ in range(n + 1)]
        for last, (length, score, ids) in self.finder.iter(unit):
            into[last + 1].append((last + 1 - length, score, ids))
        if not self.singles.issuperset(unit):
            for i, c in enumerate(unit):
                if c not in self.singles:
                    into[i + 1].append((i, self.unknown, tuple([self.bytes[b] for b in (MARK if c == OWN_MARK else c).encode()])))
        for j in range(1, n + 1):
            top, by = LOWEST, None
            for edge in into[j]:
                score = best[edge[0]] + edge[1]
                if score > top or score == top and self.earlier(back, edge, by):
                    top, by = score, edge
            best[j], back[j] = top, by
        return best, back, into

    @staticmethod
    def earlier(back: list, one: tuple, other: tuple) -> bool:
        """Whether the Viterbi path that ends with edge ``one`` has smaller ids than that with ``other``; both are followed back to where they meet."""
        a, b = [one[2]], [other[2]]
        at, to = one[0], other[0]
        while at != to:
            if at > to:
                at, _, ids = back[at]
                a.append(ids)
            else:
                to, _, ids = back[to]
                b.append(ids)
        return [x for own in reversed(a) for x in own] < [x for own in reversed(b) for x in own]

    def paths(self, unit: str, nbest: int) -> list[Path]:
        """The N best (score, ids), best first: backward A* with the forward scores as exact heuristics."""
        best, back, into = self.forward(unit)
        found: list[Path] = []
        # What a path loses, order of pushing, the node it leads back to, and the ids from there on.
        heap: list[tuple] = [(0, 0, len(unit), None)]
        pushed = 0
        while heap and len(found) < nbest:
            loss, _, at, after = heapq.heappop(heap)
            while at:
                follow, top = back[at], best[at]
                if len(found) + 1 < nbest:
                    for edge in into[at]:
                        if edge is not follow:
                            pushed += 1
                            heapq.heappush(heap, (loss + top - best[edge[0]] - edge[1], pushed, edge[0], (edge[2], after)))
                at, after = follow[0], (follow[2], after)
            ids: list[int] = []
            while after:
                ids += after[0]
                after = after[1]
            found.append((best[-1] - loss, tuple(ids)))
        return found

    def solve(self, unit: str) -> tuple[int, int, list[int]]:
        """The first path of the search, score and ids, and between them what the next one in its heap loses."""
        n = len(unit)
        pairs = self.pairs
        cuts = [k for k in range(1, n) if unit[k - 1 : k + 1] not in pairs]
        if cuts:
            rows = [self[unit[i:j]] for i, j in zip([0, *cuts], [*cuts, n])]
            ids = [x for r in rows for x in self.pool[self.ends[r] : self.ends[r + 1]]]
            return sum([self.scores[r] for r in rows]), min([self.losses[r] for r in rows]), ids
        best, back, into = self.forward(unit)
        at, loss, parts = n, NO_PATH, []
        while at:
            follow, top = back[at], best[at]
            for edge in into[at]:
                if edge is not follow and (x := top - best[edge[0]] - edge[1]) < loss:
                    loss = x
            parts.append(follow[2])
            at = follow[0]
        return best[n], loss, [x for own in reversed(parts) for x in own]

    def __missing__(self, unit: str) -> int:
        score, loss, ids = self.solve(unit)
        row = len(self.scores)
        self.scores.append(score)
        self.losses.append(loss)
        self.pool.extend(ids)
        self.ends.append(len(self.pool))
        if row < REMEMBERED:
            self[unit] = row
        return row

    def forget(self) -> None:
        """Drop the rows that are not remembered, or all where long units have filled the memory."""
        if self.ends[min(REMEMBERED, len(self.scores))] > POOL:
            self.clear()
            self.scores, self.losses, self.ends, self.pool = array("q"), array("q"), array("q", [0]), array("I")
        del self.scores[REMEMBERED:], self.losses[REMEMBERED:], self.ends[REMEMBERED + 1 :], self.pool[self.ends[-1] :]

    def changes(self, unit: str) -> list[tuple[int, bytes]]:
        """(loss, ids) of the second to the N-th best path of a unit."""
        known = self.searched.get(unit)
        if known is None:
            (top, _), *others = self.paths(unit, self.nbest)
            known = [(top - score, array("I", ids).tobytes()) for score, ids in others]
            if len(unit) <= LONG and len(self.searched) < SEARCHED:
                self.searched[unit] = known
        return known

    def nbest_of(self, text: str) -> list[tuple[int, bytes]]:
        """(score, ids as little-endian unsigned 32-bit bytes) of the N best segmentations of a text."""
        return self.nbest_of_all([text])[0]

    def nbest_of_all(self, texts: list[str]) -> list[list[tuple[int, bytes]]]:
        """``nbest_of`` of each text."""
        units: list[str] = []
        counts = []
        for text in texts:
            own = UNITS.findall(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)) if text else []
            units += own
            counts.append(len(own))
        rows = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        scores, losses, ends = (np.frombuffer(x, np.int64)[rows + k] for x, k in ((self.scores, 0), (self.losses, 0), (self.ends, 1)))
        starts = np.frombuffer(self.ends, np.int64)[rows]
        lengths = ends - starts
        upto = np.r_[0, np.cumsum(lengths)]
        at = np.arange(upto[-1]) + np.repeat(starts - upto[:-1], lengths)
        pool = np.frombuffer(self.pool, np.uint32)[at].astype("<u4").tobytes()
        total = np.r_[0, np.cumsum(scores)]
        self.forget()
        out, end = [], 0
        for n in counts:
            begin, end = end, end + n
            low, high = int(upto[begin]), int(upto[end])
            best = pool[4 * low : 4 * high]
            score = int(total[end] - total[begin])
            found = [(score, best)]
            for loss, changes in self.cheapest(units[begin:end], losses[begin:end]):
                ids = best
                for k, own in sorted(changes, reverse=True):  # from the end, so that places before stay
                    a, b = int(upto[begin + k]) - low, int(upto[begin + k + 1]) - low
                    ids = ids[: 4 * a] + own + ids[4 * b :]
                found.append((score - loss, ids))
            out.append(found)
        return out

    def cheapest(self, units: list[str], losses: np.ndarray) -> list[tuple[int, tuple[tuple[int, bytes], ...]]]:
        """(loss, changes of units) of the second to the N-th best segmentation of a text.

        Of single changes only the N - 1 cheapest can matter: no sum without them is cheaper.
        """
        sums: list[tuple[int, tuple[tuple[int, bytes], ...]]] = [(0, ())]
        losses = losses.copy()
        for _ in range(min(self.nbest - 1, len(units))):
            k = int(losses.argmin())
            if losses[k] == NO_PATH:
                break
            losses[k] = NO_PATH
            options = [(0, b""), *self.changes(units[k])]
            both = [(a + x, (*changes, (k, ids)) if ids else changes) for a, changes in sums for x, ids in options]
            sums = sorted(both, key=itemgetter(0))[: self.nbest]
        return sums[1:]

    def spell(self, segmentations: list[bytes]) -> list[bytes]:
        """The UTF-8 text of each segmentation, all at once; the space mark that begins each text is left out."""
        ids = np.frombuffer(b"".join(segmentations), "<u4").astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        data = self.letters[at].tobytes()
        bounds = np.r_[0, ends][np.cumsum([0, *(len(x) // 4 for x in segmentations)])].tolist()
        return [data[a:b].removeprefix(b" ") for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation."""
        return self.spell([ids])[0].decode()


_lattices: dict[tuple[str, int], Lattice] = {}


def lattice(path: str | None = None, nbest: int = NBEST) -> Lattice:
    """The lattice of this Python process for a model file (a parameter; the public one unless given)."""
    key = (path or public_tokenizers.path(MODEL), nbest)
    if key not in _lattices:
        _lattices[key] = Lattice(*key)
    return _lattices[key]


ENCODED = "doc_id long, segmentations array<struct<score:long,ids:binary>>, intact boolean"
SEGMENTATION = pa.struct([("score", pa.int64()), ("ids", pa.binary())])


def encode(docs: DataFrame, nbest: int = NBEST, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its N best segmentations, and whether all of them decode to the text."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model, nbest)
        for batch in batches_of(batches, 200, 1 << 20, "text"):
            texts = batch["text"].to_pylist()
            solved = pieces.nbest_of_all(texts)
            spelled = pieces.spell([ids for s in solved for _, ids in s])
            wanted = [t.encode("utf-8", "surrogatepass") for t in texts]
            at = np.cumsum([0, *map(len, solved)]).tolist()
            intact = [all([x == t for x in spelled[a:b]]) for t, a, b in zip(wanted, at, at[1:])]
            flat = pa.StructArray.from_arrays([pa.array([x for s in solved for x, _ in s], pa.int64()), pa.array([x for s in solved for _, x in s], pa.binary())], fields=list(SEGMENTATION))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), pa.array(intact, pa.bool_())], ["doc_id", "segmentations", "intact"])

    return narrow.mapInArrow(solve, ENCODED)


def decode(segmented: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return segmented.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(spell, "doc_id long, text string")


def op3_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's N best segmentations of its whole text: scores and ids (little-endian unsigned 32-bit), all decoded again."""
    rows = encode(read(spark, sf_dir, "documents"))
    each = F.col("segmentations")
    return rows.select(
        "doc_id", F.size(each).cast("long").alias("n_segmentations"), (F.octet_length(each[0]["ids"]) / 4).cast("long").alias("n_pieces"),
        each[0]["score"].alias("best_score"), F.transform(each, lambda s: s["score"]).alias("scores"), F.transform(each, lambda s: s["ids"]).alias("ids"), "intact",
    )
