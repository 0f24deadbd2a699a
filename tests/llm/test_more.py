"""Clashing columns, session state, long texts, and operators against plain versions of their method."""

import gzip
import hashlib
import re
import time
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
INTERNAL = (
    "__hash __bucket __gone __kid __khost __kkey __row_key __own_id __own_key __own_spans __blob __salt __findings __all __spans __mentions __terms "
    "__id __text_key __host __keep __lane __rank __path at tie range bucket salt key data unit stats id piece length flag sig n first copies"
).split()


def rows_with(spark, columns, texts):
    """doc_id, text, lang, source, n_chars, and the named columns with a value of their own in each row."""
    data = [(i, t, "en", f"src{i % 2}", len(t), *[f"{c}={i}" for c in columns]) for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame(data, names)


TEXTS = [
    "write to ann@mail.example.com or call +1 (743) 555-3824 about the zebra", 'password = "abcd1234efgh" and more words follow here', "",
    "a plain text about rivers and hills and nothing else at all today", "another plain text, with other words about seas and boats and winds",
    *[f"text number {i} of many that speak about this and that in ten words or more" for i in range(20)],
]


@pytest.mark.parametrize("name", ["shards", "rules", "private", "secrets", *["quality rules", "quality classifier", "near duplicates", "secret scan"]])
def test_other_columns_come_back(spark, name):
    """Every operator that returns whole rows keeps columns that are named as its own are."""
    import corpus_pipeline
    from corpuslens.llm import pii, rules, secrets, sharding

    docs = rows_with(spark, INTERNAL, TEXTS)
    if name in dict(corpus_pipeline.STAGES):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        assert out.columns == docs.columns
    else:
        apply = {"shards": lambda d: sharding.shuffle_rows(d, 3), "rules": rules.apply, "private": pii.sanitise, "secrets": secrets.redact}[name]
        out = apply(docs)
    found = out.collect()
    assert found or name == "quality classifier"
    for r in found:
        assert all(r[c] == f"{c}={r.doc_id}" for c in INTERNAL)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op7", "op8", "op9", "op10"])
def test_operators_of_own_columns_ignore_others(spark, name):
    from corpuslens.llm import fingerprints, packing, partenum, pieces, pii, quality, rules, secrets, warc

    docs = rows_with(spark, INTERNAL, TEXTS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int").withColumn("stats", F.lit("s"))
    pages = docs.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u")).withColumn("digest", F.lit("x")).withColumn("refers_to", F.lit("y"))
    apply = {
        "op1": lambda: packing.pack(docs), "op2": lambda: quality.classify(docs, labels), "op3": lambda: pieces.encode(docs), "op4": lambda: fingerprints.fingerprint(docs),
        "op5": lambda: warc.resolve(pages), "op7": lambda: rules.judge(docs)[0], "op8": lambda: pii.find_private(docs), "op9": lambda: secrets.ledger_scan(docs)[1],
        "op10": lambda: partenum.link(docs),
    }
    assert len(apply[name]().collect()) == len(TEXTS)


def test_session_settings_stay(spark):
    from corpuslens.llm.registry import QUERIES

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.checkpoint.dir")
    before = [spark.conf.get(n) for n in names]
    for q in ("op5_revisits", "op6_external_shuffle", "op7_line_frequency"):
        QUERIES[q](spark, SF).count()
    assert [spark.conf.get(n) for n in names] == before


def test_no_shared_folder_is_an_error():
    from corpuslens.llm.common import shared_dir

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default)))


def test_intermediates_go_on_request(spark, tmp_path):
    from pathlib import Path

    from corpuslens.llm import common

    df = common.materialise(spark.range(3), "some")
    path = Path(common._paths[-1].removeprefix("file:"))
    assert df.count() == 3 and path.exists()
    common.remove_intermediates(spark)
    assert not path.exists() and not common._paths


def test_batches_are_bounded():
    import pyarrow as pa

    from corpuslens.llm.common import batches_of

    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 100, "", "c" * 5, "d"]})
    parts = list(batches_of([batch, batch.slice(0, 0)], 2, 20, "t"))
    assert [p.num_rows for p in parts] == [2, 1, 2, 1]
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])


# long texts


@pytest.mark.parametrize("kind", ["emails", "secrets"])
def test_many_matches_in_one_text(spark, kind):
    """Right, and linear in the matches: four times as many take far less than sixteen times as long."""
    from corpuslens.llm import spans as S
    from corpuslens.llm.pii import base_spans, sanitise
    from corpuslens.llm.secrets import redact, scan

    one = (lambda i: f"né{i}@mail{i}.example.com") if kind == "emails" else (lambda i: f"token=abcdefgh{i}")
    pattern, label = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "email") if kind == "emails" else (r"token=([A-Za-z0-9+/_.=-]+)", "assign")
    took = {}
    for n in (10, 20_000, 80_000):
        text = " ".join(one(i) for i in range(n))
        docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
        began = time.perf_counter()
        got = docs.select(S.joined(base_spans(F.col("text")) if kind == "emails" else scan(F.col("text"))).alias("s")).first().s
        took[n] = time.perf_counter() - began
        assert got == ",".join(f"{label}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text))
        if n == 20_000:
            assert (redact(docs) if kind == "secrets" else sanitise(docs)).first().text == " ".join(["[SECRET]" if kind == "secrets" else "né[EMAIL]"] * n)
    assert took[80_000] < 10 * took[20_000]


def test_running_and_counts(spark):
    from corpuslens.llm import spans as S

    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 1000):
        v, q = rng.integers(0, 500, n).tolist(), rng.integers(0, 500, 40).tolist()
        df = spark.createDataFrame([(v, q)], "v array<int>, q array<int>")
        row = df.select(S.running(F.col("v"), lambda a, x: a + x, 0).alias("s"), S.running(F.col("v"), S.later, 0).alias("m"), S.counts_below(F.col("v"), F.col("q")).alias("c")).first()
        assert row.s == np.cumsum(v).tolist() and row.m == (np.maximum.accumulate(v).tolist() if n else [])
        assert row.c == [sum(x < p for x in v) for p in q]


def test_terms_far_off_in_code_points_are_near_in_words(spark):
    from corpuslens.llm.pii import find_private, scan

    long = [c * 39 for c in "bcdefgh"]
    text = "zebrafish " + " ".join(long) + " 1234567890" * 40 + " ann@mail.example.com " + " ".join(long) + " yellowtail"
    own = spark.createDataFrame([(0, text)], "doc_id long, text string")
    terms = set(scan(own).first()["__mentions"][0]["terms"])
    assert terms == {"zebrafish", "yellowtail", *long}
    rest = [(10 + i, f"some people talk about item{i} from time to time, writes one keeper") for i in range(60)]
    found = find_private(spark.createDataFrame([(0, text), *rest], "doc_id long, text string")).filter("__id = 0").first()
    kinds = Counter(s["kind"] for s in found["__all"])
    assert kinds["email"] == 1 and kinds["remove"] + kinds["general"] == 16


# 1 packing


def test_tokens_equal_the_library_on_all_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpuslens.llm.tokens import units

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(units().ids(t), "<u4").tolist() == want.ids


def test_plan_is_no_worse_than_first_fit_decreasing():
    from corpuslens.llm.packing import plan

    rng = np.random.default_rng(6)
    for _ in range(60):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 65, 20), rng.integers(1, 9, 20))}
        gaps: list[int] = []
        for x in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            at = next((i for i, g in enumerate(gaps) if g >= x), None)
            if at is None:
                gaps.append(64)
                at = len(gaps) - 1
            gaps[at] -= x
        assert sum(times for times, _ in plan(counts, 64)) <= len(gaps)


def test_places_do_not_depend_on_lanes(spark):
    from corpuslens.llm.packing import piece_table, place

    pieces = piece_table(spark.read.parquet(f"{SF}/documents.parquet"), 256)
    few, many = (place(pieces, 256, n).collect() for n in (10**9, 3))
    assert len({r.sequence_id for r in few}) == len({r.sequence_id for r in many})
    for rows in (few, many):
        ends = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 256


# 2 classifier


def test_classifier_against_one_solve(spark):
    """Partition-summed equations and binned calibration against NumPy on all rows at once."""
    import zlib

    from corpuslens.llm import quality as Q

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in Q.classify(docs.repartition(7), labels).collect()}
    rows = docs.select("doc_id", "text").toPandas()
    stats = np.array([Q.statistics(t or "") for t in rows.text])
    model = Q.Model(stats.mean(axis=0), np.where(stats.std(axis=0) > 0, stats.std(axis=0), 1))
    truth = labels.toPandas().dropna(subset=["quality"]).groupby("doc_id").quality.mean()
    fold = rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3)
    known = rows.doc_id.isin(truth.index)
    y = rows.doc_id.map(truth)
    fit, held = known & (fold == 0), known & (fold == 2)
    z = model.features(stats[fit])
    model.weights = np.linalg.solve(z.T @ z + Q.RIDGE * np.eye(z.shape[1]), z.T @ y[fit].to_numpy())
    raw, truth_held = model.raw(stats[held]), y[held].to_numpy()
    bins = np.round(np.clip(raw, -0.5, 1.5) * (Q.BINS / 2))
    steps = sorted((raw[bins == b].mean(), truth_held[bins == b].mean(), (bins == b).sum()) for b in np.unique(bins))
    model.knots = Q.isotonic(*np.array(steps).T)
    assert (np.diff(model.knots[1]) >= 0).all()
    want = dict(zip(rows.doc_id, model.score(stats)))
    assert max(abs(got[d] - want[d]) for d in want) < 1e-3
    assert np.mean([(got[d] >= 0.5) == (want[d] >= 0.5) for d in want]) > 0.999


# 4 fingerprints


def plain_cover(a, b, length):
    """The share of ``a``, of the longer text, in the common start, the common end, or any common span of ``length``."""
    if not a or not b:
        return float(a == b)
    same = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    start = same(a, b)
    marks = np.zeros(len(a), bool)
    marks[:start] = True
    marks[len(a) - min(same(a[::-1], b[::-1]), min(len(a), len(b)) - start) :] = True
    there = {b[j : j + length] for j in range(len(b) - length + 1)}
    for i in range(len(a) - length + 1):
        if a[i : i + length] in there:
            marks[i : i + length] = True
    return marks.sum() / max(len(a), len(b))


def test_likeness_is_that_of_common_extensions(spark):
    from corpuslens.llm.fingerprints import Joined, Prefixes, likeness, op4_prefix_hashes

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(docs)
    rows = {r.doc_id: r for r in op4_prefix_hashes(spark, SF).collect()}
    for d, after in zip(order, order[1:] + order[:1]):
        own, following = docs[d], docs[after]
        edited = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        assert rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((rows[d].near_edited, edited), (rows[d].near_next, following)):
            assert (got == 1) == (own == other)
            assert plain_cover(own, other, 96) - 0.02 <= got <= plain_cover(own, other, 24), d
    a, b = "abcdefghij" * 30 + "the middle of the one" + "klmnopqrst" * 30, "x" * 50 + "klmnopqrst" * 30 + "abcdefghij" * 30
    assert likeness(Prefixes(a), Prefixes(b)) == pytest.approx(plain_cover(a, b, 100)) and plain_cover(a, b, 100) > 0.8
    joined = Joined(Prefixes(a), 100, Prefixes(b), 60)
    assert likeness(Prefixes(a[:100] + b[:60]), joined) == 1.0


@pytest.mark.parametrize("n", [2_000, 20_000, 200_000])
def test_likeness_is_the_same_at_every_length(n):
    from corpuslens.llm.fingerprints import Prefixes, likeness

    text = "".join(np.random.default_rng(n).choice(list("abcdefgh "), n))
    edited = "".join("#" + text[i + 1 : i + 400] for i in range(0, n, 400))
    assert likeness(Prefixes(text), Prefixes(edited)) == pytest.approx(1 - 1 / 400, abs=1e-4)
    moved = text[n // 2 :] + text[: n // 2]
    assert likeness(Prefixes(text), Prefixes(moved)) > 0.999 - 1 / n


def test_fingerprints_of_repeated_and_missing_ids(spark):
    from corpuslens.llm.fingerprints import fingerprint

    rows = [(None, "zero"), (1, "one"), (1, "one"), (1, "uno"), (2, None), (3, "")]
    found = fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    one = fingerprint(spark.createDataFrame([(7, "alone")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 5)]


# 5 archives


def test_archives_are_bounded_and_dated(spark, tmp_path):
    from corpuslens.llm.warc import parse, read_archives, resolve, write_archives

    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * 500) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_archives(resolve(pages, archive_bytes=40_000), str(tmp_path / "w"), date="2020-02-02T02:02:02Z")
    files = list((tmp_path / "w").glob("*.gz"))
    sizes = [len(gzip.decompress(f.read_bytes())) for f in files]
    assert max(sizes) < 4 * 40_000 and len(files) > 15
    with gzip.open(files[0]) as f:
        assert all(h["warc-date"] == "2020-02-02T02:02:02Z" for h, _ in parse(f))
    assert sorted(r.page_id for r in read_archives(spark, str(tmp_path / "w")).collect()) == list(range(200))
    write_archives(resolve(pages.limit(3)), str(tmp_path / "now"))
    with gzip.open(next((tmp_path / "now").glob("*.gz"))) as f:
        assert re.fullmatch(r"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", next(parse(f))[0]["warc-date"])


def test_no_pages(spark, tmp_path):
    from corpuslens.llm.warc import read_archives, resolve, resolved_records, write_archives

    write_archives(resolve(spark.createDataFrame([], "page_id long, url string, html string")), str(tmp_path / "w"))
    assert resolved_records(read_archives(spark, str(tmp_path / "w"))).count() == 0


# 9 secrets


def test_query_scans_a_blob_once(spark):
    """The query's second run meets a ledger: what the first run scanned isn't scanned again."""
    from corpuslens.llm.secrets import ledger_scan

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    middle = docs.agg(F.max("doc_id")).first()[0] // 2
    first, _ = ledger_scan(docs.filter(F.col("doc_id") <= middle))
    second, paths = ledger_scan(docs, first)
    blobs = [{r.blob for r in x.select("blob").collect()} for x in (first, second)]
    assert blobs[0] and blobs[1] and not blobs[0] & blobs[1]
    assert blobs[0] | blobs[1] == {r["__blob"] for r in paths.collect()}


# 10 near duplicates


def words(seed, n, **changed):
    out = [f"w{seed}x{k}" for k in range(n)]
    for k, v in changed.items():
        out[int(k[1:])] = v
    return " ".join(out)


def test_repeated_and_missing_ids_lose_no_link(spark):
    from corpuslens.llm.partenum import link

    a, b = words(1, 100), words(2, 100)
    near_a, near_b = words(1, 100, p50="other"), words(2, 100, p50="other")
    rows = [(1, a), (1, b), (2, near_a), (3, near_b), (None, a), (None, "a text that nobody else has at all"), (4, None), (4, "x")]
    found = link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, None), (4, 4), (4, 4)])


def test_hot_signatures_go_apart_and_lose_no_link(spark, monkeypatch):
    """A passage that all share and a large family, with small buffers so that signatures count as hot."""
    from test_llm import linked

    from corpuslens.llm import partenum

    monkeypatch.setattr(partenum, "HOT", 8)
    monkeypatch.setattr(partenum, "FLUSH", 2000)
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = {}
    for i in range(120):
        body = [f"{'base' if i < 80 else i}w{k}" for k in range(90)]
        for k in rng.integers(0, 90, int(rng.integers(0, 6))):
            body[k] = f"e{i}x{k}"
        rows[i] = " ".join(body) + " " + passage
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.link(docs).collect()}
    assert found == linked(rows)


def test_word_hashes_in_pieces(monkeypatch):
    from corpuslens.llm import partenum

    texts = ["", " ", "a", "a b c d e", "x" * 300, "é b\tc\x0bd e f " * 50, "A B C D E"]
    whole = partenum.shingle_sets(texts)
    monkeypatch.setattr(partenum, "PIECE", 16)
    assert all((x == y).all() for x, y in zip(whole, partenum.shingle_sets(texts)))
    assert (whole[3] == whole[6]).all() and [len(x) for x in whole[:5]] == [0, 0, 1, 1, 1]


# pipeline


def test_stages_against_plain_versions(spark):
    """Rules, classifier and packing of the pipeline, each on its own input."""
    import corpus_pipeline as P
    from corpuslens.llm import quality
    from corpuslens.llm.tokens import units

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = {r.doc_id: r for r in stages["quality rules"](spark, docs, SF).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for d, t in texts.items():
        own = word.findall(t)
        windows = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
        covered = {k for i in range(len(own) - 4) if windows[tuple(own[i : i + 5])] > 1 for k in range(i, i + 5)}
        if len(own) < 10 or 100 * len(covered) > 20 * len(own):
            assert d not in kept
        elif d in kept:
            assert set(kept[d].text.split("\n")) <= set(t.split("\n")) and kept[d].n_chars == len(kept[d].text)
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    good = {r.doc_id for r in stages["quality classifier"](spark, docs, SF).collect()}
    assert good == {d for d, p in scores.items() if p}
    packed = stages["packing"](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in packed) == Counter({d: -(-(len(units().ids(t)) // 4 + 1) // 2048) for d, t in texts.items()})


def test_many_entities_and_words_in_one_text(spark):
    """A thousand emails among sixteen thousand different words; each word beside an email discloses it."""
    from corpuslens.llm.pii import find_private

    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    words = [f"w{name(i)}" for i in range(16_000)]
    text = " ".join(w if i % 16 else f"u{i}@mail.example {w.upper()}" for i, w in enumerate(words))
    rows = [(0, text)] + [(i, f"plain text number {i}") for i in range(1, 80)]
    found = {r["__id"]: r for r in find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = found[0]["__all"]
    assert sum(s["kind"] == "email" for s in own) == 1000 and len(own) > 15_000
    assert all(text[s["start"] : s["end"]] == s["value"] for s in own)
    assert {s["value"].lower() for s in own if s["kind"] in ("remove", "general")} <= {*words}
    assert all(not r["__all"] for i, r in found.items() if i)


@pytest.mark.parametrize("others", [30, 3000])
def test_verdicts_on_terms_do_not_depend_on_the_corpus_size(spark, others):
    from corpuslens.llm.pii import find_private

    rows = [(i, f"zebrafish news number {i}, from ann@mail.example.com") for i in range(5)]
    rows += [(10, "a yellowtail writes from bob@mail.example.com")]
    rows += [(100 + i, f"plain news number {i} writes from somewhere") for i in range(others)]
    found = find_private(spark.createDataFrame(rows, "doc_id long, text string")).filter("size(__all) > 0").collect()
    assert {(s["kind"], s["value"]) for r in found for s in r["__all"] if s["kind"] != "email"} == {("remove", "zebrafish"), ("general", "yellowtail")}


def test_terms_that_tell_much_of_an_entity_go(spark):
    """A term that two of 3000 documents have tells most of an entity that one has, though it leaves the choice of two; it is generalised."""
    from corpuslens.llm.pii import find_private

    rows = [(0, "a yellowtail writes from bob@mail.example.com"), (1, "another yellowtail writes nothing")]
    rows += [(2 + i, f"zebrafish news number {i}, from ann@mail.example.com") for i in range(2)]
    rows += [(100 + i, f"plain news number {i} writes from somewhere") for i in range(3000)]
    found = find_private(spark.createDataFrame(rows, "doc_id long, text string")).filter("size(__all) > 0").collect()
    assert {(s["kind"], s["value"]) for r in found for s in r["__all"] if s["kind"] != "email"} == {("general", "yellowtail"), ("remove", "zebrafish")}


def test_terms_of_an_entity_that_all_documents_hold(spark):
    from corpuslens.llm.pii import find_private

    rows = [(i, f"zebrafish news {i} from ann@mail.example.com") for i in range(6)]
    found = find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(s["kind"], s["value"]) for r in found for s in r["__all"] if s["kind"] != "email"} == {("remove", "zebrafish"), ("remove", "news"), ("remove", "from")}


def test_stages_keep_no_more_than_their_results_read(spark):
    """Signatures, groups, measured lines and the like are gone when a stage returns, and its result is whole without them."""
    import corpus_pipeline

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = set(folder.iterdir())
        rows = stage(spark, docs, SF)
        left[name] = {re.sub("-[0-9a-f]{32}$", "", p.name) for p in set(folder.iterdir()) - before} - {"kept"}
        assert rows.count() == len(rows.collect()) > 0
    assert left == {"quality rules": {"families", "rules-kept"}, "quality classifier": {"good"}, "near duplicates": {"firsts"}}


def test_a_line_over_the_share_of_a_large_host_is_frequent(spark):
    """21 of 2000 documents are more than a hundredth."""
    from corpuslens.llm import rules

    rows = [(i, f"page {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" + ("\nshared footer of this host" if i < 21 else ""), "h") for i in range(2000)]
    _, frequent = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert frequent.count() == 1


def test_op7_removes_a_line_of_over_twenty_documents_from_a_host_of_any_size(spark, tmp_path):
    from corpuslens.llm import rules

    rows = [(i, f"page {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" + ("\nshared footer here" if i < 21 else "\nheld by twenty" if i < 41 else ""), "h") for i in range(2300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id: r.n_words - r.words_left for r in rules.op7_line_frequency(spark, str(tmp_path)).collect()}
    assert left == {i: 3 if i < 21 else 0 for i in range(2300)}
