"""bigWig files written and read back, and their layout."""

import random
import struct

import numpy as np

from strandloom import cli
from strandloom.sources.bigwig import _ITEM, _File, parse_bigwig, read_bigwig


def test_round_trip_of_many_sections(tmp_path):
    rng = random.Random(1)
    for n in (0, 1, 1024, 1025, 300_000):
        ends = np.cumsum([rng.randrange(1, 4) for _ in range(n)])
        items = np.zeros(n, _ITEM)
        items["start"], items["end"], items["value"] = np.concatenate([[0], ends[:-1]]) if n else [], ends, [rng.randrange(9) for _ in range(n)]
        out = _File(str(tmp_path / "x"), "chr1", 10**6)
        for a in range(0, n, 7000):
            out.add(items[a : a + 7000])
        out.close()
        got = list(parse_bigwig(str(tmp_path / "x")))
        assert all(g[:2] == ("chr1", 10**6) for g in got) and sum(len(g[2]) for g in got) == n
        assert not n or (np.concatenate([g[2] for g in got]) == items).all()
        data = (tmp_path / "x").read_bytes()
        covered, low, high, total, _ = struct.unpack_from("<Qdddd", data, 64)
        assert covered == (int(ends[-1]) if n else 0) and total == float(((items["end"] - items["start"]) * items["value"].astype(float)).sum())


def test_depth_becomes_a_file_a_chromosome(spark, tmp_path):
    (tmp_path / "d.txt").write_text("c\t3\t5\nc\t4\t5\nc\t6\t1\nx\t1\t2\n")
    (tmp_path / "s.txt").write_text("c\t9\nd\t4\n")
    cli.main(["cov2bw", "-i", str(tmp_path / "d.txt"), "-g", str(tmp_path / "s.txt"), "-o", str(tmp_path / "out"), "--prefix", "p"], spark)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["p.c.bigWig", "p.d.bigWig"]
    rows = sorted(tuple(r) for r in read_bigwig(spark, str(tmp_path / "out")).collect())
    assert rows == [("c", 9, 0, 2, 0.0), ("c", 9, 2, 4, 5.0), ("c", 9, 4, 5, 0.0), ("c", 9, 5, 6, 1.0), ("c", 9, 6, 9, 0.0), ("d", 4, 0, 4, 0.0)]
