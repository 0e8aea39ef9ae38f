"""Every dealt operator on the awkward table, on an empty one and against its definition."""

from collections import Counter, defaultdict
import hashlib
import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
import tiktoken

from strataforge.llm import quality as q
from strataforge.llm.bpe import RANKS, bpe_decode, bpe_encode, token_ranks
from strataforge.llm.embeddings import SmallWorld, embedding_links, joined, search_pair
from strataforge.llm.exact_dedup import build_levels, exact_dedup, slots
from strataforge.llm.graph import components
from strataforge.llm.jaccard import jaccard_components
from strataforge.llm.packing import TOKENIZER, pack
from strataforge.llm.quality import fit_quality, isotonic, keep_good, quality_scores, quality_statistics
from strataforge.llm.sharding import stratified_shards, write_shards
from strataforge.llm.store import RID, P, materialize
from strataforge.llm.substrings import RESULT, substring_dedup
from strataforge.llm.suffixes import suffix_dedup
from strataforge.llm.warc import parse_record, read_records, record_bytes, write_archives
from tests.llm import brute
from tests.llm.conftest import awkward_texts
from tests.llm.test_text import twins

TEXTS = awkward_texts()
key = lambda rows: sorted(map(repr, rows))


@pytest.fixture(params=["rows", "files"])
def docs(request, awkward, scanned):
    return awkward if request.param == "rows" else scanned


def test_exact_dedup(docs, empty):
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs).collect()]
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert key(got) == key((i, top[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS)
    kept = exact_dedup(docs).where("kept").collect()
    assert len(kept) == len(groups) and {r.text_sha256: r.doc_id for r in kept} == {hashlib.sha256(t.encode()).hexdigest(): i for t, i in top.items()}
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_with_a_given_history(awkward):
    every = {r.text_sha256 + str(r.doc_id): (r.keep_id, r.group_size) for r in exact_dedup(awkward).collect()}
    for history in (F.lit(True), F.lit(False), F.coalesce(F.col("doc_id"), F.lit(0)) < 12):
        assert {r.text_sha256 + str(r.doc_id): (r.keep_id, r.group_size) for r in exact_dedup(awkward, historical=history).collect()} == every


def test_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(5000)), np.uint8).reshape(-1, 32)
    levels = build_levels(digests)
    assert sorted(slots(digests, levels).tolist()) == list(range(5000))
    other = np.frombuffer(hashlib.sha256(b"other").digest(), np.uint8).reshape(1, 32)
    assert -1 <= slots(other, levels)[0] < 5000


def test_bpe(docs, empty):
    path = public_tokenizers.path(RANKS)
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_ranks(path), special_tokens={})
    got = bpe_decode(bpe_encode(docs, path), path).collect()
    assert key((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got) == key((i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()) for i, t in TEXTS for ids in [encoder.encode_ordinary(t or "")])
    assert bpe_decode(bpe_encode(empty, path), path).count() == 0


def test_packing(docs, empty):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = sorted(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for _, t in TEXTS)
    rows = pack(docs, public_tokenizers.path(TOKENIZER), 64).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length > 0
        sequences[r.sequence_id].append(r)
    stream = b""
    for number in range(len(sequences)):
        at = 0
        for r in sorted(sequences[number], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            stream += bytes(r.ids)
        assert at == 64 or number == len(sequences) - 1
    whole, at = [], 0
    for r in sorted((r for r in rows if r.start == 0), key=lambda r: (r.sequence_id, r.offset)):  # documents lie whole along the stream
        whole.append(stream[4 * at : 4 * (at + r.doc_tokens)])
        at += r.doc_tokens
    assert sorted(whole) == want
    assert pack(empty, public_tokenizers.path(TOKENIZER)).count() == 0


def test_sharding(docs, empty, spark, tmp_path):
    n, shards = len(TEXTS), 5
    rows = stratified_shards(docs, shards).collect()
    assert key((r.doc_id, r.size, r.text_crc32) for r in rows) == key((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(shards)) and max(count.values()) - min(count.values()) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    share = Counter(r.source for r in rows)
    for (s, source), k in Counter((r.shard, r.source) for r in rows).items():
        assert abs(k - share[source] * count[s] / n) < 2
    assert stratified_shards(empty, shards).count() == 0


def test_sharding_is_repeatable(scanned):
    one, two = (key(tuple(r) for r in stratified_shards(scanned, 5).collect()) for _ in range(2))
    assert one == two


def test_write_shards(scanned, spark, tmp_path):
    placed = materialize(stratified_shards(scanned, 3))
    write_shards(scanned, placed, str(tmp_path / "shards"), columns=["doc_id", "text"])
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(TEXTS)
    assert len([x for x in os.listdir(tmp_path / "shards") if x.startswith(P)]) == 3


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 100)])
def test_jaccard(awkward, size, percent):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(awkward, size, percent).collect()]
    want = brute.jaccard(TEXTS, size, percent)
    # a null id whose set is empty or alone has no component id
    assert key(got) == key(want)


def test_jaccard_of_files_and_nothing(scanned, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(scanned).collect()]
    assert key(got) == key(brute.jaccard(TEXTS, 4, 85))
    assert jaccard_components(empty).count() == 0


def test_components(spark):
    links = [(9, 8), (8, 7), (7, 3), (1, 2), (5, 6), (6, 1), (20, 21)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {9: 3, 8: 3, 7: 3, 3: 3, 1: 1, 2: 1, 5: 1, 6: 1, 20: 20, 21: 20} | {k: 100 for k in range(100, 141)}


def test_substrings(docs, empty):
    got = [(r[f"{P}id"], *(r[c] for c in RESULT)) for r in substring_dedup(docs, carry=["kept", "n_words", "lang"]).collect()]
    want = brute.windows_removed(TEXTS, 13)
    assert key(got) == key(want) and sum(r[2] > 0 for r in want) > 10
    assert substring_dedup(empty).count() == 0


def test_suffixes(docs, empty):
    got = [(r[f"{P}id"], *(r[c] for c in RESULT)) for r in suffix_dedup(docs, carry=["kept"]).collect()]
    assert key(got) == key(brute.windows_removed(TEXTS, 50))
    assert suffix_dedup(empty).count() == 0


def test_warc(spark, empty, tmp_path):
    big = "<p>" + "x" * 2000 + "é"
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (None, "u", big), (4, "u\r\n%41", "small"), (5, "u", "small"), (6, "v", None), (8, "v", ""), (9, "w", "y" * 3_000_000), (9, "w", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    index = write_archives(pages, f"file://{tmp_path}/warc")
    got = read_records(index).collect()
    plain = [(r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in got]
    assert key(plain) == key((i, u, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, u, h in rows)
    assert key((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == key([(1, 7), (3, 7), (None, 7), (9, 9)])
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h in rows}
    some = read_records(index.where("page_id in (5, 7)")).collect()
    assert {r.page_id for r in some} == {5, 7}
    assert read_records(write_archives(pages.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_warc_record_is_checked():
    good = record_bytes(1, "u", b"abc", hashlib.sha1(b"abc").digest(), None, False)
    assert parse_record(good)["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        parse_record(record_bytes(1, "u", b"abc", hashlib.sha1(b"abd").digest(), None, False))


def test_quality(awkward, scanned, empty, spark):
    clean = [(k, " ".join(TEXTS[k % 3][1].split()[k % 50 :])) for k in range(100, 220)]
    noisy = [(k, " ".join(w.upper() + "!!%%" for w in TEXTS[k % 3][1].split()[k % 50 :])) for k in range(220, 340)]
    docs = spark.createDataFrame(clean + noisy, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 220)) for i, _ in clean + noisy] + [(None, 1), (100, None)], "doc_id long, quality int")
    statistics = quality_statistics(docs)
    model = fit_quality(statistics, labels)
    scores = {r.doc_id: r.score for r in quality_scores(statistics, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.5) == (i < 220) for i in held]) > 0.95
    assert {r.doc_id for r in keep_good(docs, model).collect()} == {i for i, s in scores.items() if s >= 0.5}
    other = quality_scores(quality_statistics(awkward), model).collect()
    assert len(other) == len(TEXTS) and all(0 <= r.score <= 1 for r in other)
    assert keep_good(scanned, model).columns == scanned.columns
    assert quality_scores(quality_statistics(empty), model).count() == 0
    # held-out labels and other labels of one kind teach nothing
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality_scores(statistics, fit_quality(statistics, flipped)).collect()} == scores
    assert {r.score for r in quality_scores(statistics, fit_quality(statistics, labels.where("quality = 1"))).collect()} == {0.5}
    assert {r.score for r in quality_scores(statistics, fit_quality(statistics, labels.limit(0))).collect()} == {0.5}


def test_isotonic_is_monotone():
    assert (np.diff(isotonic(np.arange(2.0), np.array([1.0, 1000.0]), np.array([0.0, 10.0]))[1]) >= 0).all()
    rnd = np.random.default_rng(1)
    for _ in range(50):
        n = rnd.integers(1, 400, 200).astype(float)
        good = rnd.binomial(n.astype(int), rnd.uniform(0, 1, 200) * np.linspace(0.1, 0.9, 200)).astype(float)
        at, curve = isotonic(np.arange(200.0), n, good)
        assert (np.diff(curve) >= 0).all() and (np.diff(at) > 0).all() and 0 < curve.min() and curve.max() < 1
        # the pooled means by their definition: largest of the least means over ranges
        mean = lambda i, j: good[i : j + 1].sum() / n[i : j + 1].sum()
        k = int(rnd.integers(0, 200))
        want = max(min(mean(i, j) for j in range(k, 200)) for i in range(k + 1))
        assert min(abs(curve - want)) < 1e-2 and abs(np.clip(want, curve.min(), curve.max()) - curve[np.abs(curve - want).argmin()]) < 1e-9


def test_quality_against_plain_numpy(spark):
    """Ridge on the same features, fitted on all rows at once, and pooled over bins: the same scores."""
    texts = {k: " ".join(w if (k * 7 + j) % 5 else w.upper() + "!" * (k % 3) for j, w in enumerate(TEXTS[k % 3][1].split()[: 20 + k % 60])) for k in range(400)}
    labels = {k: int((k * 7919) % 10 < (8 if k % 3 == 0 else 3)) for k in texts}
    docs, marks = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    statistics = quality_statistics(docs)
    got = {r.doc_id: r.score for r in quality_scores(statistics, fit_quality(statistics, marks)).collect()}
    fold = {k: zlib.crc32(str(k).encode()) % 3 for k in texts}
    x = {k: q.text_statistics(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for k, t in texts.items()}
    train = [k for k in texts if fold[k] != 1]
    m = np.array([x[k] for k in train])
    mean, scale = m.mean(axis=0), np.maximum(m.std(axis=0), 1e-6)
    z = {k: q.fourier(x[k][None], mean, scale)[0] for k in texts}

    def ridge(rows):
        a, y = np.array([z[k] for k in rows]), np.array([labels[k] for k in rows], float)
        return np.linalg.solve(a.T @ a + q.RIDGE * len(rows) * np.eye(a.shape[1]) / q.FOURIER, a.T @ y)

    crossed = {f: ridge([k for k in train if fold[k] == 2 - f]) for f in (0, 2)}
    low, high = q.RANGE
    bins = defaultdict(list)
    for k in train:
        bins[int(np.clip((z[k] @ crossed[fold[k]] - low) / (high - low) * q.BINS, 0, q.BINS - 1))].append(labels[k])
    at = sorted(bins)
    curve_at, curve = isotonic(low + (np.array(at) + 0.5) / q.BINS * (high - low), np.array([len(bins[b]) for b in at], float), np.array([sum(bins[b]) for b in at], float))
    weights = ridge(train)
    want = {k: float(np.interp(z[k] @ weights, curve_at, curve)) for k in texts}
    raw = sorted(texts, key=lambda k: z[k] @ weights)
    assert all(got[a] <= got[b] + 1e-12 for a, b in zip(raw, raw[1:]))
    assert np.mean([abs(got[k] - want[k]) < 1e-6 for k in texts]) > 0.97  # a score at a bin's edge may fall either way


def test_sharding_against_a_plain_ranking(scanned):
    """Shards and slots from the ranks as defined: seeded shuffle within a source, fractional rank, equal cuts."""
    seed, shards = 20, 5
    hashed = scanned.select("doc_id", "text", "source", F.xxhash64(F.col("_metadata.file_path")).alias("f"), F.col("_metadata.row_index").alias("r"))
    rows = hashed.select("*", F.xxhash64(F.lit(seed), "text").alias("shuffle"), F.xxhash64(F.lit(seed), "f", "r").alias("tie"), F.xxhash64(F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).alias("stratum")).collect()
    strata = defaultdict(list)
    for r in rows:
        strata[r.source].append(r)
    order = []
    for members in strata.values():
        members.sort(key=lambda r: (r.shuffle, r.tie))
        order += [((k + 0.5) / len(members), r.stratum, r.tie, r) for k, r in enumerate(members)]
    order.sort(key=lambda x: x[:3])
    n = len(order)
    want = {(r.f, r.r): (k * shards // n, k - -(-(k * shards // n) * n // shards)) for k, (*_, r) in enumerate(order)}
    assert {(r[RID[0]], r[RID[1]]): (r.shard, r.slot) for r in stratified_shards(scanned, shards).collect()} == want


def test_texts_that_powers_of_a_base_confuse(spark):
    """Two words of a Thue-Morse pattern and its complement, alone and among others: nothing takes one for the other."""
    rows = []
    for k, size in enumerate((1024, 2048, 4096)):
        one, two = twins(size)
        rows += [(10 * k, one), (10 * k + 1, two), (10 * k + 2, f"{one} {'x ' * 60}"), (10 * k + 3, f"{two} {'x ' * 60}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path(RANKS)
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_ranks(path), special_tokens={})
    assert {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in bpe_decode(bpe_encode(docs, path), path).collect()} == {i: (np.array(encoder.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in rows}
    pieces = defaultdict(dict)
    for r in pack(docs, public_tokenizers.path(TOKENIZER)).collect():
        pieces[r.doc_id][r.start] = bytes(r.ids)
    assert {i: b"".join(x[k] for k in sorted(x)) for i, x in pieces.items()} == {i: np.array([*encoder.encode_ordinary(t), 0], "<u4").tobytes() for i, t in rows}
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()) == key(brute.jaccard(rows, 4, 85))
    assert key((r[f"{P}id"], *(r[c] for c in RESULT)) for r in substring_dedup(docs).collect()) == key(brute.windows_removed(rows, 13))
    assert key((r[f"{P}id"], *(r[c] for c in RESULT)) for r in suffix_dedup(docs).collect()) == key(brute.windows_removed(rows, 50))


def test_an_id_does_not_depend_on_its_neighbours(spark):
    """New and unassigned characters, and added tokens, in one batch with plain texts."""
    texts = ["a\ua7cb's b", ":\U0003d000", "x <|endoftext|> y's", "<|endof", "text|>", "plain it's 12 words", None, "\ua7cb's", "<|endoftext|>"]
    rows = list(enumerate(texts))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    got = {r.doc_id: bytes(r.ids) for r in pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public_tokenizers.path(TOKENIZER)).collect()}
    assert got == {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in rows}
    path = public_tokenizers.path(RANKS)
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_ranks(path), special_tokens={})
    encoded = bpe_encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path)
    assert {r.doc_id: bytes(r.ids) for r in encoded.collect()} == {i: np.array(encoder.encode_ordinary(t or ""), "<u4").tobytes() for i, t in rows}


def test_archives_are_read_in_parts(spark, tmp_path):
    # archives have random names, so stretches are dealt by chance: of enough of them some land in three tasks
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        html = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: F.sha2(F.concat_ws("-", "id", x), 256)))
        pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), html.alias("html")).repartition(2)
        records = read_records(write_archives(pages, f"file://{tmp_path}/warc"))
        used = records.select(F.spark_partition_id().alias("p"), "page_id").groupBy("p").count().collect()
        assert len(used) > 2 and sum(r["count"] for r in used) == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_are_bounded_by_bytes_and_rows(spark):
    from strataforge.llm import blocks as b

    rows = [(k, "w " * (400_000 if k % 9 == 0 else 5)) for k in range(40)] + [(k, None) for k in range(40, 40_000)]
    table, size = b.blocked(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), "doc_id", "text", [])
    per = table.groupBy(b.BLOCK).agg(F.count("*").alias("n"), F.countDistinct(b.SLOT).alias("slots"), F.max(b.SLOT).alias("most"), F.sum(F.octet_length(b.TEXT)).alias("bytes"), F.max(F.octet_length(b.TEXT)).alias("one")).collect()
    assert sum(r.n for r in per) == 40_000 and all(r.n == r.slots == r.most + 1 <= b.BLOCK_ROWS for r in per)
    assert all((r.bytes or 0) <= b.BLOCK_BYTES[0] + (r.one or 0) for r in per) and size == sum(r.bytes or 0 for r in per)


def test_a_hash_of_all_documents_is_an_entry_per_block(spark):
    from strataforge.llm import blocks as b
    from strataforge.llm.substrings import cover_anchors

    line = "one line that stands in every single document of this table here and there"
    docs = spark.createDataFrame([(k, f"{line} {k} {k + 1}") for k in range(3000)], "doc_id long, text string").coalesce(1)
    table, size = b.blocked(docs, "doc_id", "text", [])
    entries = cover_anchors(table, 13, 1)
    held = entries.select(F.sum(F.octet_length("hashes") / 5).cast("long")).first()[0]
    assert table.select(b.BLOCK).distinct().count() == 1 and held < 3000 * 4


def test_embeddings(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(12, 16))
    vectors = [(k, (centres[k % 12] + 0.13 * rnd.normal(size=16)).astype("f4").tolist()) for k in range(300)] + [(k, rnd.normal(size=16).astype("f4").tolist()) for k in range(300, 420)]
    vectors += [(500 + k, vectors[0][1]) for k in range(40)] + [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [1.0] * 15 + [None]), (605, [float("inf")] * 16), (606, [1.0] * 8), (607, [2.0] * 8), (None, vectors[1][1]), (5, vectors[5][1])]
    got = embedding_links(spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, kept string")).collect()
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v) else None for _, v in vectors]
    links = [(a, b) for a in range(len(unit)) for b in range(a) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    degree = Counter(x for pair in links for x in pair)
    classes = brute.components(len(unit), links)
    least = {c: min((vectors[k][0] for k in range(len(unit)) if classes[k] == c and vectors[k][0] is not None), default=None) for c in classes}
    assert len(links) > 3000
    assert key((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == key((vectors[k][0], degree[k], least[c], vectors[k][0] == least[c]) for k, c in enumerate(classes))
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_small_world_recall():
    rnd = np.random.default_rng(2)
    vectors = rnd.normal(size=(1500, 24))
    vectors[::3] = vectors[0] + 0.2 * rnd.normal(size=(500, 24))  # one dense cluster
    names = np.arange(1500)
    graph = SmallWorld.load(np.load(io.BytesIO(SmallWorld(vectors, names).dump())))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    truth = unit @ unit.T >= 0.9
    found, beam = graph.links(vectors, 0.9, 16, names, names)
    a, b = joined(list(found))
    hit = np.zeros_like(truth)
    hit[a, b] = True
    assert beam and (hit & truth).sum() >= 0.99 * truth.sum()


@pytest.mark.parametrize("hot", [0, 500])
def test_nodes_that_no_beam_reaches_are_found(hot):
    """Small groups that the graph has no way to, beside a hot group or none: audits fail until beams are as wide as the shard."""
    rnd = np.random.default_rng(4)
    vectors = rnd.normal(size=(1500, 24))
    vectors[:hot] = vectors[0] + 0.1 * rnd.normal(size=(hot, 24))
    vectors[1300:] = np.repeat(vectors[1300::5], 5, axis=0) + 0.1 * rnd.normal(size=(200, 24))
    names = np.arange(1500)
    graph = SmallWorld(vectors, names)
    for _, near in graph.levels:
        near[near >= 1300] = -1
    graph.kin = np.where(graph.kin >= 1300, np.repeat(names, np.diff(graph.kin_at)), graph.kin)
    assert graph.links(vectors, 0.9, 32, names, names)[1] == 0
    shelf = names, np.ones(1500, int), vectors, graph
    outside, beyond, a, b = search_pair(shelf, shelf, 0.9)
    assert not beyond.any()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    truth = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1)).tolist()
    assert len(truth) > 300 and outside.tolist() == np.bincount(np.ravel(truth), minlength=1500).tolist()
    assert brute.components(1500, list(zip(a.tolist(), b.tolist()))) == brute.components(1500, truth) and len(a) < 3000


def test_audits_count_links_of_a_node_to_others_only():
    rnd = np.random.default_rng(3)
    vectors, names = rnd.normal(size=(600, 32)), np.arange(600)
    vectors[500:] = vectors[400:500] + 0.01 * rnd.normal(size=(100, 32))
    graph = SmallWorld(vectors, names)
    found, beam = graph.links(vectors, 0.9, 16, names, names)
    a, b = joined(list(found))
    assert beam == 16 and (a != b).sum() == 200


@pytest.mark.parametrize("pairs", [0, 20])
def test_audits_are_bounded_where_links_are_rare(monkeypatch, pairs):
    from strataforge.llm import embeddings as e

    rnd = np.random.default_rng(11)
    vectors, names = rnd.normal(size=(4000, 32)), np.arange(4000)
    vectors[4000 - pairs :] = vectors[:pairs] + 0.05 * rnd.normal(size=(pairs, 32))
    halves = [(names[k::2], np.ones(2000, int), vectors[k::2], SmallWorld(vectors[k::2], names[k::2])) for k in (0, 1)]
    compared, plain = [], SmallWorld.exact
    monkeypatch.setattr(SmallWorld, "exact", lambda self, unit, least: compared.append(len(unit)) or plain(self, unit, least))
    degree = np.zeros(4000, int)
    for one, other in ((0, 0), (0, 1), (1, 1)):
        outside, beyond, _, _ = search_pair(halves[one], halves[other], 0.9)
        degree[halves[one][0]] += outside
        degree[halves[other][0]] += beyond
    assert max(compared) <= e.AUDITED and sum(compared) <= 4 * e.AUDITED
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert degree.sum() == 2 * pairs and (degree == (unit @ unit.T >= 0.9).sum(axis=1) - 1).all()


def test_a_pair_that_one_end_finds_counts_at_both():
    rnd = np.random.default_rng(12)
    vectors, names = rnd.normal(size=(300, 16)), np.arange(300)
    vectors[150:160] = vectors[:10] + 0.05 * rnd.normal(size=(10, 16))
    shelves = [(names[k : k + 150], np.arange(1, 151), vectors[k : k + 150], SmallWorld(vectors[k : k + 150], names[k : k + 150])) for k in (0, 150)]
    blind = SmallWorld(vectors[:150], names[:150])
    blind.found = lambda queries, *_: np.zeros((len(queries), 19), np.uint8)
    for one, other in (shelves, shelves[::-1], [(*shelves[0][:3], blind), shelves[1]], [shelves[1], (*shelves[0][:3], blind)]):
        outside, beyond, a, b = search_pair(one, other, 0.9)
        assert sorted(outside.nonzero()[0]) == sorted(beyond.nonzero()[0]) == list(range(10)) and (outside[:10] == np.arange(1, 11)).all() and (beyond[:10] == np.arange(1, 11)).all()
        assert sorted(zip(a.tolist(), b.tolist())) == [(150 + k, k) for k in range(10)] or sorted(zip(a.tolist(), b.tolist())) == [(k, 150 + k) for k in range(10)]


def test_vectors_whose_products_overflow(spark):
    rows = [(1, [3e200, 4e200]), (2, [3.0, 4.0]), (3, [-3e200, 4e200]), (4, [3e-200, 4e-200])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}


def test_embeddings_recall_outside_a_hot_group(spark):
    rnd = np.random.default_rng(6)
    vectors = rnd.normal(size=(1200, 24))
    vectors[:400] = vectors[0] + 0.1 * rnd.normal(size=(400, 24))
    vectors[1000:] = np.repeat(vectors[1000::5], 5, axis=0) + 0.1 * rnd.normal(size=(200, 24))
    vectors = vectors.astype("f4")
    got = {r.vec_id: r.n_links for r in embedding_links(spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<float>")).collect()}
    unit = vectors / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert true[:400].min() > 300 and true[1000:].sum() > 600
    for part in (slice(0, 400), slice(400, 1200)):
        assert sum(got[k] for k in range(1200)[part]) >= 0.99 * true[part].sum()
    assert all(got[k] <= true[k] for k in range(1200))

