"""Merkle fingerprints against plain trees, and neighbours against a plain sort."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from strataforge.llm.fingerprints import SPAN, edits, fingerprints, likeness, op12_fingerprints, with_next, with_tree
from strataforge.llm.store import RID, identified
from tests.llm.conftest import awkward_texts

SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()


def tree(text):
    paragraphs = [[SHA(p) for p in s.split("\n")] for s in text.split("\n\n")]
    sections = [SHA("".join(x)) for x in paragraphs]
    return SHA("".join(sections)), sections, paragraphs, set(re.findall(f"[^\n]{{1,{SPAN}}}", text))


def alike(x, y):
    a, b = tree(x), tree(y)
    if a[0] == b[0]:
        return 1.0
    leaves = [{p for s in t[2] for p in s} for t in (a, b)]
    return 2 * (len(a[3] & b[3]) + len(leaves[0] & leaves[1])) / (len(a[3]) + len(b[3]) + len(leaves[0]) + len(leaves[1]) + 2)


@pytest.mark.parametrize("kind", ["awkward", "scanned"])
def test_trees(request, kind):
    got = {(r.doc_id, r.root, tuple(r.sections), len(r.spans)) for r in fingerprints(request.getfixturevalue(kind)).collect()}
    want = set()
    for i, t in awkward_texts():
        root, sections, _, spans = tree(t or "")
        want.add((i, root, tuple(sections), len(spans)))
    assert got == want


def test_no_rows(empty):
    assert fingerprints(empty).count() == 0
    rows = identified(empty.select("doc_id", "text"), "doc_id", "text")
    assert with_next(rows).count() == 0


PAIRS = [("a\nb\n\nc\nd", "a\nb\n\nc\nX"), ("a\n\n\nb", "a\n\nb"), ("", ""), ("", "a"), ("same text " * 9, "same text " * 9), ("x" * 50 + "\ny", "x" * 50), ("é" * 13 + "\U0001f600", "é" * 13 + "\U0001f601"), ("a\r\nb c\x85d", "a\r\nb c\x85e"), ("p\n\nq", "p\n\nq\n\nr")]


def test_likeness_and_edits(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(PAIRS)], "k int, a string, b string")
    trees = with_tree(with_tree(rows, "a", "a_"), "b", "b_")
    for r in trees.select("k", likeness("a_", "b_").alias("near"), edits("a_", "b_").alias("edits")).collect():
        a, b = PAIRS[r.k]
        assert r.near == pytest.approx(alike(a, b)) and (r.near == 1) == (a == b)
        x, y = tree(a), tree(b)
        get = lambda found, i: found[i] if i < len(found) else None
        want = []
        for i in range(max(len(x[1]), len(y[1]))):
            if get(x[1], i) != get(y[1], i):
                old, new = get(x[2], i) or [], get(y[2], i) or []
                want.append((i, [j for j in range(max(len(old), len(new))) if get(old, j) != get(new, j)]))
        assert [(e.section, e.paragraphs) for e in r.edits] == want


@pytest.mark.parametrize("ids", [[5, 3, 9, 1, 7], [4], [2, 2, 2, None, None, 8], [0] * 40 + [-(2**63), 2**63 - 1], list(range(300))])
def test_next_in_order(spark, ids, tmp_path):
    spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = identified(spark.read.parquet(f"{tmp_path}/t").select("doc_id", "text", "_metadata"), "doc_id", "text", scan=True)
    got = {r.text: r.after for r in with_next(rows).select("text", F.col("next.text").alias("after")).collect()}
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, -(ids[k] or 0), k))
    assert got == {f"text {a}": f"text {b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_parts_beyond_one_look(spark, tmp_path, monkeypatch):
    from strataforge.llm import fingerprints as f

    monkeypatch.setattr(f, "LOOK", 3)
    test_next_in_order(spark, [k * 7 % 101 for k in range(101)], tmp_path)


def test_query_on_awkward_rows(spark, awkward, tmp_path):
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_fingerprints(spark, str(tmp_path)).collect()
    texts = [t or "" for _, t in awkward_texts()]
    assert len(found) == len(texts)
    assert {(r.fingerprint, r.n_chars) for r in found} == {(tree(t)[0], len(t)) for t in texts}
    by = {SHA(t): t for t in texts}
    want = {SHA(t[: len(t) - len(t) // 3] + u[: len(t) // 3]) for t in texts for u in by.values()}
    assert {r.edited_sha256 for r in found} <= want and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert RID[0] not in op12_fingerprints(spark, str(tmp_path)).columns
