"""Files in parts: any cut, several members, plain text, and what is refused."""

import gzip
import random

import pytest

from arbolex.sources import parts


def split(path, data, size):
    for i, lo in enumerate(range(0, len(data), size)):
        (path.parent / f"{path.name}.part-{chr(97 + i // 26)}{chr(97 + i % 26)}").write_bytes(data[lo : lo + size])


LINES = [f"line {k} é \U0001f600 " + "x" * (k % 90) for k in range(3000)]


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    text = "\n".join(LINES).encode()
    split(tmp_path / "a.gz", gzip.compress(text), 701)
    split(tmp_path / "b.gz", gzip.compress(text[:5000]) + gzip.compress(b"") + gzip.compress(text[5000:] + b"\n"), 1234)
    split(tmp_path / "c.txt", text.replace(b"\n", b"\r\n"), rng.randrange(5000, 9000))
    (tmp_path / "d.gz").write_bytes(gzip.compress(text))
    return tmp_path


def test_any_cut_gives_the_lines(spark, folder):
    for name in ("a.gz", "b.gz", "c.txt", "d.gz"):
        got = [r["value"] for r in parts.read_lines(spark, [str(folder / name)]).collect()]
        assert got == LINES, name
    many = parts.read_lines(spark, [str(folder / n) for n in ("a.gz", "c.txt", "d.gz")])
    assert sorted(r["value"] for r in many.collect()) == sorted(LINES * 3)


def test_what_is_not_whole_is_refused(spark, folder):
    size = sum(p.stat().st_size for p in folder.glob("a.gz.part-*"))
    assert parts.read_lines(spark, [str(folder / "a.gz")], {str(folder / "a.gz"): size}).count() == len(LINES)
    with pytest.raises(parts.Incomplete, match="bytes of"):
        parts.read_lines(spark, [str(folder / "a.gz")], {str(folder / "a.gz"): size + 1})
    last = sorted(folder.glob("a.gz.part-*"))[-1]
    last.unlink()
    with pytest.raises(Exception, match="ends early"):
        parts.read_lines(spark, [str(folder / "a.gz")]).collect()
    (folder / "a.gz.part-ac").write_bytes(b"")
    with pytest.raises(parts.Incomplete, match="empty"):
        parts.read_lines(spark, [str(folder / "a.gz")])
    (folder / "a.gz.part-ac").unlink()
    with pytest.raises(parts.Incomplete, match="missing"):
        parts.read_lines(spark, [str(folder / "a.gz")])
