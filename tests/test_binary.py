"""Binary snapshot files that the test writes by the format's layout."""

import random
import struct
import zlib

import pytest

from kithgraph.schemas import EPOCH
from kithgraph.sources import binary
from kithgraph.sources.store import DamagedSnapshot


def bitmap(values, run=False):
    """A roaring bitmap with array, bitset or run containers."""
    parts = {}
    for v in sorted(values):
        parts.setdefault(v >> 16, []).append(v & 0xFFFF)
    bodies = []
    for own in parts.values():
        if run:
            spans = []
            for x in own:
                if spans and x == spans[-1][0] + spans[-1][1] + 1:
                    spans[-1][1] += 1
                else:
                    spans.append([x, 0])
            bodies.append(struct.pack("<H", len(spans)) + b"".join(struct.pack("<HH", *s) for s in spans))
        elif len(own) > 4096:
            bodies.append(sum(1 << x for x in own).to_bytes(8192, "little"))
        else:
            bodies.append(struct.pack(f"<{len(own)}H", *own))
    heads = b"".join(struct.pack("<HH", k, len(v) - 1) for k, v in parts.items())
    start = struct.pack("<I", 12347 | len(parts) - 1 << 16) + (((1 << len(parts)) - 1).to_bytes((len(parts) + 7) // 8, "little")) if run else struct.pack("<II", 12346, len(parts))
    offsets = bytes(4 * len(parts)) if not run or len(parts) >= 4 else b""
    return start + heads + offsets + b"".join(bodies)


POSTS = {1: list(range(5)), 2: [7, 9, 70_000, 70_001], 3: list(range(0, 10_000, 2))}


def payload(version):
    rng = random.Random(1)
    edges = {u: [(rng.randrange(99), rng.randrange(1, 4), rng.randrange(1 << 29)) for _ in range(n)] for u, n in ((1, 3), (64, 2))}
    out = struct.pack("<I", 3) + b"".join(struct.pack("<I", len(s.encode())) + s.encode() for s in ("at://é", "b", "")) + 2 * (
        struct.pack("<I", 2) + b"".join(struct.pack("<II", u, len(e)) + b"".join(struct.pack("<II", p, t << 3 | s) for p, s, t in e) for u, e in edges.items()))
    maps = [bitmap(POSTS[1]), bitmap(POSTS[2], run=True), bitmap(POSTS[3])]
    out += struct.pack("<I", 3) + b"".join(struct.pack("<II", k + 1, len(m)) + m for k, m in enumerate(maps))
    out += struct.pack("<I", 1) + struct.pack("<IIII", 5, 2, 8, 6)
    out += struct.pack("<I", 2) + b"".join(struct.pack("<IIBIBIQ", *m) + (struct.pack("<B", f) if version >= 5 else b"") for m, f in (((1, 2, 1, 3, 0, 0, 77), 1 | 2 << 1), ((4, 2, 0, 0, 1, 9, 78), 0)))
    out += struct.pack("<I", 1) + struct.pack("<IQ", 4, 99)
    if version >= 2:
        out += struct.pack("<I", 1) + struct.pack("<Ifffffff", 5, 7200, 0.25, 1, 2, 1, 0.5, 1)
        out += (b"\1" if version >= 3 else b"") + (struct.pack("<I", 8) if version >= 4 else b"") + (b"\1" if version >= 5 else b"") + struct.pack("<Q", 123)
        out += struct.pack("<I", 1) + struct.pack("<IIIQI", 5, 1, 4, 1_700_000_000, 2)
    return out, edges


def written(path, version=5, flip=None, bad_header=False):
    body, edges = payload(version)
    head = struct.pack("<4sHHQQIIIQIII", b"FYFD", version, 64, 5, 17_000_000, 0, 3, 2, 5, 1, 2, zlib.crc32(body))
    raw = bytearray(head + struct.pack("<II", zlib.crc32(head) ^ bad_header, 1) + body)
    if flip is not None:
        raw[flip] ^= 16
    path.write_bytes(bytes(raw))
    return edges


@pytest.mark.parametrize("version", [1, 3, 5])
def test_sections_come_back(spark, tmp_path, version):
    path = tmp_path / "s.bin"
    edges = written(path, version)
    rows = lambda name: [tuple(r) for r in binary.section(spark, str(path), name).collect()]
    flat = [(u, k, p, s, t + EPOCH) for k, (u, (p, s, t)) in enumerate((u, e) for u, own in edges.items() for e in own)]
    assert rows("strings") == [(0, "at://é"), (1, "b"), (2, "")] and rows("user_edges") == rows("post_edges") == flat
    assert rows("bitmaps") == [(u, p) for u, own in POSTS.items() for p in own]
    assert rows("follows") == [(5, 0, 8), (5, 1, 6)] and rows("recents") == [(4, 99)]
    new = version >= 5
    assert rows("meta") == [(1, 2, 3, None, 77, new, "tech" if new else None), (4, 2, None, 9, 78, False, None)]
    assert rows("dials") == ([(5, 7200.0, 0.25, 1.0, 2.0, 1.0, 0.5, 1.0, version >= 3, 8 if version >= 4 else 3, new, 123)] if version >= 2 else [])
    assert rows("impressions") == ([(5, 0, 4, 1_700_000_000, 2)] if version >= 2 else [])
    graph, cursor = binary.graph_of(spark, str(path))
    assert cursor == 17_000_000 and graph.edges.count() == 5 and {r["user_id"] for r in graph.users.collect()} == {1, 5, 64}
    ids = {r["value"]: r["id"] for r in binary.numbered(binary.section(spark, str(path), "strings")).collect()}
    assert len(set(ids.values())) == 3 and all(i >= 0 for i in ids.values())


def test_damage_is_found(spark, tmp_path):
    path = tmp_path / "s.bin"
    for change in ({"flip": 20}, {"flip": 64}, {"flip": 300}, {"bad_header": True}, {"flip": 0}, {"version": 5, "flip": 4}):
        written(path, **change)
        with pytest.raises(DamagedSnapshot):
            binary.header(str(path))
    with pytest.raises(Exception, match="payload"):
        written(path, flip=90)
        binary.section(spark, str(path), "meta").collect()
    path.write_bytes(b"FYFD")
    with pytest.raises(DamagedSnapshot):
        binary.header(str(path))
    with pytest.raises(Exception, match="no section"):
        spark.read.format("graph_snapshot").option("section", "x").load(str(path)).collect()
