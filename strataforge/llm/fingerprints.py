"""Document fingerprints: a Merkle tree over sections and paragraphs, by built-in functions only.

Sections are parted by blank lines, paragraphs by line ends. A paragraph's digest is the SHA-256 of
its text, a section's that of its paragraphs' digests, and the root (the fingerprint) that of the
sections' digests; the parting can be undone, so equal roots mean equal texts. Where two roots differ,
``edits`` goes down the branches that differ and names the sections and paragraphs. Each tree also keeps
a 64-bit hash for every ``SPAN`` characters of a paragraph: they tell how much of a changed paragraph is
left, and decide nothing else. ``likeness`` is twice the nodes that two trees share over the nodes of both
(distinct spans, distinct paragraphs, the root), so it is 1 exactly for equal texts.

``with_next`` gives each document the next one of an order. The order is cut into parts of equal row
counts at exact positions of narrow rows; each text goes to its part once, the first of a part also to
the part before, and neighbours meet there.

Defined cases: a null text is the empty one (one empty paragraph, no spans); a null id comes after every
id; rows of one id (or none) follow each other in file order; the only row of a table is its own next
one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.llm.store import RID, P, identified, is_scan, partitions, range_positions, total_bytes

#: Characters of a span.
SPAN = 12
#: Bytes of texts that a part aims at; parts at most (their bounds, 32 bytes each, are one literal), and bounds of a first look.
PART_TEXT, PARTS, LOOK = 32 << 20, 100_000, 256
TREE = ["root", "sections", "paragraphs", "spans"]
_KEY = [f"{P}{x}" for x in "abcd"]


def with_tree(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """``rows`` with the tree of a text column, in columns ``prefix`` + root, sections, paragraphs (by section) and spans."""
    root, sections, paragraphs, spans = (prefix + x for x in TREE)
    digest = lambda x: F.sha2(F.concat_ws("", x), 256)
    rows = rows.withColumn(paragraphs, F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256))))
    rows = rows.withColumn(sections, F.transform(paragraphs, digest)).withColumn(root, digest(F.col(sections)))
    return rows.withColumn(spans, F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{SPAN}}}"), F.lit(0)), lambda s: F.xxhash64(s))))


def likeness(a: str, b: str) -> Column:
    """How alike the trees in the columns with prefixes ``a`` and ``b`` are, 0 to 1; 1 only if the roots are equal."""
    same = F.col(f"{a}root") == F.col(f"{b}root")
    leaves = [F.array_distinct(F.flatten(f"{x}paragraphs")) for x in (a, b)]
    shared = F.size(F.array_intersect(f"{a}spans", f"{b}spans")) + F.size(F.array_intersect(*leaves))
    total = F.size(f"{a}spans") + F.size(f"{b}spans") + F.size(leaves[0]) + F.size(leaves[1]) + 2
    return F.when(same, 1.0).otherwise(2.0 * shared / total)


def edits(a: str, b: str) -> Column:
    """Where two trees differ: (section, paragraphs) from 0, only branches with other digests being opened; none for equal roots."""
    differing = lambda x, y: F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y), F.lit(1)) - 1), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))
    none = F.array().cast("array<string>")
    inside = lambda s: differing(*(F.coalesce(F.get(f"{x}paragraphs", s), none) for x in (a, b)))
    opened = F.transform(differing(F.col(f"{a}sections"), F.col(f"{b}sections")), lambda s: F.struct(s.alias("section"), inside(s).alias("paragraphs")))
    return F.when(F.col(f"{a}root") == F.col(f"{b}root"), F.array().cast("array<struct<section:int,paragraphs:array<int>>>")).otherwise(opened)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scan: bool | None = None) -> DataFrame:
    """One row per row of ``docs``: identity, doc_id, root, sections, paragraphs and spans."""
    return with_tree(_rows(docs, id_col, text_col, scan), "text", "").select(*RID, "doc_id", *TREE)


def _rows(docs: DataFrame, id_col: str, text_col: str, scan: bool | None) -> DataFrame:
    scan = is_scan(docs) if scan is None else scan
    return identified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(["_metadata"] if scan else [])), "doc_id", "text", scan=scan)


def with_next(rows: DataFrame, prepare=lambda rows: rows) -> DataFrame:  # noqa: ANN001
    """``rows`` (doc_id, text, identity) with ``next``, a struct of the columns of the row that follows by descending id.

    After the last comes the first. ``prepare`` adds columns where the rows of a part have met.
    """
    spark = rows.sparkSession
    key = [F.col("doc_id").isNull().cast("int"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")), *(F.col(c) for c in RID)]
    keyed = rows.select("*", F.struct(*(c.alias(n) for c, n in zip(key, _KEY, strict=True))).alias(f"{P}key"))
    size = total_bytes(rows, "text")
    placed = range_positions(keyed.select(*(F.col(f"{P}key.{n}").alias(n) for n in _KEY)), _KEY, "order")
    step = max(1, -(-placed.count() // min(max(4 * partitions(spark), size // PART_TEXT), PARTS)))
    firsts = [list(r) for r in placed.where(F.col(f"{P}pos") % step == 0).orderBy(f"{P}pos").select(*_KEY).collect()]  # PARTS at most
    kind = f"array<struct<{','.join(f'{n}:{t}' for n, t in zip(_KEY, ('int', 'long', 'long', 'long'), strict=True))}>>"
    literal = lambda found: F.from_json(F.lit(json.dumps([dict(zip(_KEY, x, strict=True)) for x in found])), kind)
    bounds, upto = literal(firsts), lambda found: F.size(F.filter(found, lambda b: b <= F.col(f"{P}key")))
    look = keyed.withColumn(f"{P}look", upto(literal(firsts[::LOOK])) - 1)
    part = F.col(f"{P}look") * LOOK + upto(F.slice(bounds, F.col(f"{P}look") * LOOK + 1, LOOK)) - 1
    parted = look.withColumn(f"{P}part", part).withColumn(f"{P}first", F.get(bounds, F.col(f"{P}part")) == F.col(f"{P}key"))
    place = lambda p, copy: F.struct(p.alias("part"), F.lit(copy).alias("copy"))
    own, before = place(F.col(f"{P}part"), 0), place(F.pmod(F.col(f"{P}part") - 1, F.lit(max(len(firsts), 1))), 1)
    dealt = parted.withColumn(f"{P}at", F.explode(F.when(F.col(f"{P}first"), F.array(own, before)).otherwise(F.array(own)))).select(*rows.columns, f"{P}key", f"{P}at.part", f"{P}at.copy")
    met = prepare(dealt.repartition(max(partitions(spark), size // PART_TEXT), "part"))
    columns = [c for c in met.columns if c not in (f"{P}key", "part", "copy")]
    found = F.lead(F.struct(*columns)).over(Window.partitionBy("part").orderBy("copy", f"{P}key"))
    return met.withColumn("next", found).where("copy = 0").select(*columns, "next")


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are to those and to the next document's."""
    rows = _rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", True)
    pairs = with_next(rows, lambda met: with_tree(met, "text", ""))
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.expr("cast(n_chars div 3 as int)"))
    pairs = pairs.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - cut), substring(next.text, 1, cut))"))
    pairs = with_tree(pairs.select("doc_id", "n_chars", "edited", *TREE, *(F.col(f"next.{c}").alias(f"next_{c}") for c in TREE)), "edited", "edited_")
    pairs = pairs.withColumn("edit", F.get(edits("", "edited_"), F.lit(0)))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness("", "edited_").alias("near_edited"),
        likeness("", "next_").alias("near_next"),
        F.col("edit.section").alias("edit_section"),
        F.get("edit.paragraphs", F.lit(0)).alias("edit_paragraph"),
    )


_SQL_LIKE = """CASE WHEN a.root = {b}.root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (len(list_intersect(a.spans, {b}.spans)) + len(list_intersect(a.leaves, {b}.leaves)))
           / (len(a.spans) + len({b}.spans) + len(a.leaves) + len({b}.leaves) + 2) END"""
OP12_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
           coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id
    FROM documents
), e AS (
    SELECT d.doc_id, d.text, d.n_chars, d.next_id,
           left(d.text, d.n_chars - d.n_chars // 3) || left(n.text, d.n_chars // 3) AS edited
    FROM d JOIN d n ON n.doc_id = d.next_id
), t AS (
    SELECT doc_id, 0 AS k, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e
), p AS (
    SELECT doc_id, k, list_transform(string_split(text, e'\n\n'), lambda s: list_transform(string_split(s, e'\n'), lambda x: sha256(x))) AS paragraphs,
           list_distinct(regexp_extract_all(text, '[^\n]{{1,{SPAN}}}')) AS spans
    FROM t
), s AS (
    SELECT *, list_transform(paragraphs, lambda x: sha256(array_to_string(x, ''))) AS sections, list_distinct(flatten(paragraphs)) AS leaves
    FROM p
), r AS (
    SELECT *, sha256(array_to_string(sections, '')) AS root FROM s
), f AS (
    SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.root AS fingerprint, b.root AS edited_fingerprint,
           {_SQL_LIKE.format(b="b")} AS near_edited,
           {_SQL_LIKE.format(b="c")} AS near_next,
           list_filter(range(greatest(len(a.sections), len(b.sections))), lambda i: a.sections[i + 1] IS DISTINCT FROM b.sections[i + 1])[1] AS section,
           a.paragraphs AS old, b.paragraphs AS new
    FROM e JOIN r a ON a.doc_id = e.doc_id AND a.k = 0 JOIN r b ON b.doc_id = e.doc_id AND b.k = 1 JOIN r c ON c.doc_id = e.next_id AND c.k = 0
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, section::INT AS edit_section,
       list_filter(range(greatest(coalesce(len(old[section + 1]), 0), coalesce(len(new[section + 1]), 0))), lambda j: old[section + 1][j + 1] IS DISTINCT FROM new[section + 1][j + 1])[1]::INT AS edit_paragraph
FROM f
"""
