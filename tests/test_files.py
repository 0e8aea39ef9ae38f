"""Files cut into many splits give the lines of the whole text."""

import random

import pytest

from strataforge.sources import _split_lines, read_lines


def plain(text: str, split: str) -> list[tuple]:
    kept = text.splitlines(keepends=True) if split == "unicode" else []
    if split != "unicode":
        raw, ends = text, {"bytes": ["\n"], "universal": ["\r\n", "\n", "\r"]}[split]
        while raw:
            at = [(raw.find(e), -len(e), e) for e in ends if e in raw]
            k, _, e = min(at) if at else (len(raw), 0, "")
            kept.append(raw[: k + len(e)])
            raw = raw[k + len(e) :]
    closing = ("\n",) if split == "bytes" else ("\n", "\r")
    return [(n, x.rstrip("\r\n") if split == "universal" else x.removesuffix("\n"), x.endswith(closing)) for n, x in enumerate(kept, 1)]


TEXTS = {"a": "one\r\ntwo\n\nthree\rfour", "b": "\n", "c": "x" * 300 + "\n" + "y\r\n" * 90, "d": "last\r", "e": "é \x85\x0b ü\r\n\r\n", "f": "no end", "g": "\r\r\n\n\r"}


@pytest.fixture(params=[1, 7, 64, 1 << 20])
def sized(spark, request):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for k, v in zip(keys, (request.param, 0), strict=True):
        spark.conf.set(k, v)
    yield request.param
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("split", ["bytes", "universal"])
def test_lines_of_split_files(spark, tmp_path, sized, split):
    rnd = random.Random(sized)
    texts = {**TEXTS, "r": "".join(rnd.choice(["a", "bb", "\n", "\r", "\r\n", " é"]) for _ in range(400 if sized > 1 else 60))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty").write_bytes(b"")
    lines = read_lines(spark, str(tmp_path), split)
    if sized == 7:
        assert _split_lines(spark, str(tmp_path), "\n").select("file", "start").distinct().count() > 2 * len(texts)
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.raw, r.terminated) for r in lines.collect())
    assert got == sorted((name, *x) for name, text in texts.items() for x in plain(text, split))


def test_lines_through_a_folder(spark, tmp_path, sized):
    for name in ("p-0", "p-1", "p-2"):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(9)))
    got = sorted((r.line, r.raw) for r in read_lines(spark, str(tmp_path), per="folder").collect())
    assert got == [(9 * p + k + 1, f"p-{p} {k}") for p in range(3) for k in range(9)]
    with pytest.raises(ValueError, match="by itself"):
        read_lines(spark, str(tmp_path), "unicode", per="folder")
