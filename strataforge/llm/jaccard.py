"""N-gram Jaccard join by vertical partitioning, with classes instead of all pairs.

Every distinct shingle set is one class (two independent 64-bit digests of the set), so copies never pair
up: one row of a class stands for all. Blocks of texts send their distinct shingles, counted, to the
fragments that own their hash ranges and learn how frequent each is. Frequency orders all shingles
globally: those of one class only come first, so a class of which too few shingles are shared has
an empty prefix and drops out. The others' shared shingles are cut at fixed frequencies into
fragments of that global order; pairs that meet at a prefix shingle have their partial overlaps
counted in each fragment and summed per pair.

What is asked for are components, so the members of a prefix shingle are first paired with a few
pivots of about their size; only lists that still hold several components pair up completely,
across components. No pair that could join two components is left out.

Defined cases: A-Z count as a-z; a null or wordless text has an empty set and links with nothing; a
text of fewer words than a shingle is one shingle; a null id is never a component's id unless all
its ids are null; repeated rows are rows of their own; an empty table gives an empty result; other
columns are not read. Shingles are compared by 64-bit hashes: of two compared sets of n and m shingles one of n m / 2**64
is counted too much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.blocks import BLOCK, ENTRIES, ID, SLOT, TEXT, Words, blocked, carried, entry_rows, fragments_for, joined, of_kind, reports, told, word_slices
from strataforge.llm.graph import components
from strataforge.llm.pieces import cells
from strataforge.llm.store import RID, P, identified, is_scan, materialize, with_group
from strataforge.llm.textcore import mix, packed_rows, ragged, window_hashes, windows

#: Pivots of a prefix shingle and size class.
PIVOTS = 3
#: Frequencies at which the global order is cut.
CUTS = (4, 8, 16)
_SETS = f"{BLOCK} long, {SLOT} int, {RID[0]} long, {RID[1]} long, doc_id long, n_shingles long, {P}set binary"
_CLASSES = "set long, n long, m long, prefix binary, segments array<binary>"


def shingle_sets(part: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text of a slice, one text after another, and their counts."""
    at, text = windows(part.first, size)
    count = np.diff(part.first)
    found, of = [window_hashes(part.hashes, at, size)], [text]
    for k in range(1, size):  # a text of fewer words is one shingle
        short = np.flatnonzero(count == k)
        found.append(window_hashes(part.hashes, part.first[short], k))
        of.append(short)
    found, text = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], np.bincount(text[new], minlength=len(count))


def set_digests(found: np.ndarray, counts: np.ndarray) -> pa.Array:
    """16 bytes for each set that no order of its shingles changes: two sums of differently mixed hashes; null for an empty set."""
    end, out = np.cumsum(counts), np.zeros((len(counts), 2), "<u8")
    for k, seed in enumerate((0x632BE59BD9B4E019, 0x9FB21C651E98DF25)):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(mix(found + np.uint64(seed)) ^ np.uint64(seed)), dtype=np.uint64)))
        out[:, k] = mix(total[end] - total[end - counts] + counts.astype(np.uint64))
    return pa.array([x.tobytes() if n else None for x, n in zip(out, counts, strict=True)], pa.binary())


def frequency(start: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classes that hold a hash, less one, as a byte: exact up to 64, eight steps for each doubling beyond. It orders all shingles alike everywhere."""
    total = np.add.reduceat(counts.astype(np.int64), start)
    return np.repeat(np.where(total <= 64, total - 1, np.minimum(63 + 8 * np.log2(total / 64), 255)).astype(np.uint8), size)


def _chosen(docs: pa.Table, rows: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a block that stand for a class: shingles, their counts, classes; distinct shingles and how many sets hold each."""
    stands = np.full(1 << 16, -1)
    stands[rows[SLOT].to_numpy()] = rows["set"].to_numpy()
    found, counts = [], []
    mine = docs.filter(pa.array(stands[docs[SLOT].to_numpy()] >= 0))
    for part in word_slices(mine[TEXT], lower=True):
        some, per = shingle_sets(part, size)
        found.append(some)
        counts.append(per)
    found, counts = joined(found, np.uint64), joined(counts)
    keys, per = np.unique(found, return_counts=True)
    return found, counts, stands[mine[SLOT].to_numpy()], keys, per


def _classes(found: np.ndarray, counts: np.ndarray, names: np.ndarray, freq: np.ndarray, percent: int) -> pa.Table:
    """Classes that can have links: prefix, and shared shingles cut by the global order. ``freq`` is 0 for shingles of one class."""
    owner, n = np.repeat(np.arange(len(counts)), counts), counts
    found, freq, owner = found[freq > 0], freq[freq > 0], owner[freq > 0]
    m = np.bincount(owner, minlength=len(counts))
    spare = m - (-(-percent * n // 100)) + 1
    some = spare[owner] > 0
    found, freq, owner = found[some], freq[some], owner[some]
    alive = np.flatnonzero((spare > 0) & (n > 0))
    number = np.full(len(counts), -1)
    number[alive] = np.arange(len(alive))
    order = np.lexsort((found, freq, owner))
    per = np.bincount(number[owner], minlength=len(alive))
    prefix = found[order][ragged(np.cumsum(per) - per, spare[alive])]
    segments = []
    for low, high in zip((0, *(c - 1 for c in CUTS)), (*(c - 1 for c in CUTS), 256), strict=True):
        inside = (freq >= low) & (freq < high)  # found is sorted in each set
        segments.append(packed_rows(np.bincount(number[owner[inside]], minlength=len(alive)), found[inside]))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(segments) * len(alive) + 1, len(segments)), pa.int32()), pa.concat_arrays(segments).take(pa.array(np.arange(len(segments) * len(alive)).reshape(len(segments), -1).T.ravel())))
    return pa.table([pa.array(names[alive]), pa.array(n[alive]), pa.array(m[alive]), packed_rows(spare[alive], prefix), lists], names=["set", "n", "m", "prefix", "segments"])


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = cells(batch.column(3))
        count = np.diff(offsets) // 8
        row = np.repeat(np.arange(len(batch)), count)
        rest = batch.column(2).to_numpy()[row] - ragged(np.zeros(len(count), np.int64), count)
        yield pa.RecordBatch.from_arrays([pa.array(data.view(np.int64)), *(batch.column(k).take(pa.array(row)) for k in range(3)), pa.array(rest)], ["shingle", "set", "n", "m", "rest"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Common shingles of two segments, row by row: one sort of a run of rows, equal neighbours counted."""
    for batch in batches:
        out = np.zeros(len(batch), np.int64)
        sides = [cells(batch.column(k)) for k in (3, 4)]
        total = np.cumsum(sum(np.diff(at) // 8 for _, at in sides))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 18), "right")))
            row = np.concatenate([np.repeat(np.arange(b - a), np.diff(at[a : b + 1]) // 8) for _, at in sides])
            value = np.concatenate([data[at[a] : at[b]].view("<u8") for data, at in sides])
            order = np.lexsort((value, row))
            same = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
            out[a:b] = np.bincount(row[order][1:][same], minlength=b - a)
            a = b
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(out)], ["a", "b", "size", "common"])


def overlapping(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that reach ``percent``, by partial overlaps summed over the fragments."""
    segments = classes.select("set", F.posexplode("segments").alias("fragment", "shingles")).where(F.length("shingles") > 0)
    left = pairs.select("a", "b", (F.col("na") + F.col("nb")).alias("size")).join(segments.select(F.col("set").alias("a"), "fragment", F.col("shingles").alias("left")).hint("merge"), "a")
    both = left.join(segments.select(F.col("set").alias("b"), "fragment", F.col("shingles").alias("right")).hint("merge"), ["b", "fragment"])
    counted = both.select("a", "b", "size", "left", "right").mapInArrow(_partial, "a long, b long, size long, common long")
    # common / (size - common) >= percent / 100
    return counted.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("size").alias("size")).where(F.col("common") * (100 + percent) >= F.col("size") * percent).select("a", "b")


def _pair(x: str, y: str) -> list:
    swap = F.col(f"{x}set") > F.col(f"{y}set")
    return [F.when(swap, F.col(f"{q}{c}")).otherwise(F.col(f"{p}{c}")).alias(n) for c, p, q, n in (("set", x, y, "a"), ("set", y, x, "b"), ("n", x, y, "na"), ("n", y, x, "nb"), ("rest", x, y, "ra"), ("rest", y, x, "rb"))]


def near_classes(rows: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their set's digest and size; the distinct sets (digest, number ``set``, rows, least id); (node, component) of linked sets."""
    spark = rows.sparkSession
    blocks, total = blocked(rows, "doc_id", "text", RID)
    fragments = fragments_for(spark, total, 1)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in word_slices(pa.chunked_array([batch.column(0)]), lower=True):
                found, counts = shingle_sets(part, size)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(part.row, len(counts)) for k in range(1, 6)), pa.array(counts, pa.int64()), set_digests(found, counts)], [x.split(" ")[0] for x in _SETS.split(", ")])

    def shingles(docs: pa.Table, stand: pa.Table) -> pa.Table:
        if not len(stand):
            return entry_rows(0, np.zeros(0, np.uint64), np.zeros(0, "<u4"), fragments)
        *_, keys, per = _chosen(docs, stand, size)
        return entry_rows(docs[BLOCK][0].as_py(), keys, per.astype("<u4"), fragments)

    def ordered(docs: pa.Table, here: pa.Table) -> pa.Table:
        found, counts, names, keys, _ = _chosen(docs, of_kind(here, 0), size)
        freq = told(of_kind(here, 1), keys, fragments)
        return _classes(found, counts, names, freq[np.searchsorted(keys, found)], percent)

    table = materialize(blocks.select(TEXT, BLOCK, SLOT, *(F.col(n).alias(c) for n, c in zip(carried(RID), RID, strict=True)), F.col(ID).alias("doc_id")).mapInArrow(sets, _SETS), "sets")
    # one row stands for a class
    stand = table.where("n_shingles > 0").groupBy(f"{P}set").agg(F.min(F.struct(BLOCK, SLOT)).alias("r"), F.count("*").alias("rows"), F.min("doc_id").alias("least"))
    every = materialize(stand.select(f"{P}set", F.monotonically_increasing_id().alias("set"), F.col(f"r.{BLOCK}").alias(BLOCK), F.col(f"r.{SLOT}").alias(SLOT), "rows", "least"), "stand")
    stand = every.select(BLOCK, SLOT, "set", F.lit(0).alias("kind"))
    entries = blocks.groupBy(BLOCK).cogroup(stand.groupBy(BLOCK)).applyInArrow(shingles, ENTRIES)
    frequencies = reports(entries, 2 * total, frequency, 8, "<u4").withColumn("kind", F.lit(1))
    both = stand.unionByName(frequencies, allowMissingColumns=True)
    classes = materialize(blocks.groupBy(BLOCK).cogroup(both.groupBy(BLOCK)).applyInArrow(ordered, _CLASSES), "classes")
    prefix = materialize(classes.select("set", "n", "m", "prefix").mapInArrow(_prefix_rows, "shingle long, set long, n long, m long, rest long"), "prefix")
    links, labels = None, None
    # sizes fit, and so do the shingles from here on in the global order: ``rest`` bounds the overlap
    # of two classes whose first common shingle this is
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.least("ra", "rb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent) & (F.col("a") != F.col("b"))
    renamed = lambda p: {c: p + c for c in ("set", "n", "rest", "component")}

    def members() -> DataFrame:
        """The prefix lists with their members' components."""
        if labels is None:
            return prefix.withColumn("component", F.col("set"))
        known = prefix.join(labels.withColumnRenamed("node", "set"), "set", "left")
        return materialize(known.withColumn("component", F.coalesce("component", "set")), "lists")

    for turn in range(PIVOTS + 1):
        lists, by = members(), ["shingle"]
        if turn < PIVOTS:  # sizes within a size class fit
            lists, by = lists.withColumn("class", F.floor(F.log("n") / max(float(np.log(100 / percent)), 1e-6))), ["shingle", "class"]
        # the first pivot is the member that shares the largest part of its shingles with others:
        # most likely what the others are copies of; later pivots have the least seeded hash
        rank = [(-F.col("m") / F.col("n")).alias("r")] if turn == 0 else []
        pivot = F.min(F.struct(*rank, F.xxhash64("set", F.lit(turn)).alias("h"), "set", "n", "rest", "component")).alias("p")
        groups = lists.groupBy(*by).agg(pivot, F.min("n").alias("least"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        groups = materialize(groups.select(*by, "least", *(F.col(f"p.{c}").alias(f"p{c}") for c in renamed("p"))), "pivots")
        # a member needs enough shingles from here on for the smallest set that it can meet here
        other = F.greatest(F.col("least"), F.ceil(F.col("mn") * percent / 100))
        met = lists.withColumnsRenamed(renamed("m")).join(groups, by).where(F.col("mrest") * (100 + percent) >= (F.col("mn") + other) * percent)
        if turn == PIVOTS:
            left = materialize(met.select("shingle", *renamed("m").values()), "open")
            met = left.join(left.withColumnsRenamed({f"m{c}": f"p{c}" for c in renamed("p")}), "shingle").where("mcomponent < pcomponent")
        pairs = materialize(met.where("mcomponent <> pcomponent").select(*_pair("m", "p")).where(fits).select("a", "b", "na", "nb").distinct(), "pairs")
        if pairs.isEmpty():
            continue
        good = materialize(overlapping(pairs, classes, percent), "links")
        if not good.isEmpty():
            links = good if links is None else links.union(good)
            labels = components(links, labels)
    if labels is None:
        labels = spark.createDataFrame([], "node long, component long")
    return table, every, labels


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", *, scan: bool | None = None) -> DataFrame:
    """One row per row of ``docs``: identity, class, doc_id, n_shingles, component_id (its smallest id), component_size."""
    scan = is_scan(docs) if scan is None else scan
    rows = identified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(["_metadata"] if scan else [])), "doc_id", "text", scan=scan).select(*RID, "doc_id", "text")
    table, every, labels = near_classes(rows, size, percent)
    sizes = materialize(every.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn(f"{P}class", F.coalesce("component", "set")), "classes")
    named = sizes.groupBy(f"{P}class").agg(F.min("least").alias("component_id"), F.sum("rows").alias("component_size"))
    groups = materialize(sizes.select(f"{P}set", "rows", f"{P}class").join(named, f"{P}class"), "named")
    columns = [*RID, f"{P}class", "doc_id", "n_shingles", "component_id", "component_size"]
    linked = with_group(table.where("n_shingles > 0"), groups, f"{P}set", "rows").select(*columns)
    alone = table.where("n_shingles = 0").select(*RID, F.lit(None).cast("long").alias(f"{P}class"), "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("component_size"))
    return linked.union(alone)


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 4-word shingles reach a Jaccard similarity of 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), scan=True).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
     e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
     r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
     m AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.v = d.doc_id
"""
