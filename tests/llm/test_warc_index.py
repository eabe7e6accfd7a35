"""Archives: exact round trips, revisits against a plain computation, and the global order."""

import hashlib
import random

from relata.llm import warc_index as w


def plain(pages):
    by = {}
    for p, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            by[b] = max(p, by.get(b, p))
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        to = by.get(b) if p is not None and by.get(b, p) != p else None
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return out


def corpus(seed):
    rng = random.Random(seed)
    bodies = ["<p>é</p>\r\n\r\n" * 200, "x" * 1000, "y" * 999, "WARC/1.1\r\n\r\n" * 100]
    hosts = ["a.org", "b.a.org", "z.net", "Z.net"]
    pages = [(i, f"http://{rng.choice(hosts)}/{rng.randrange(5)}", rng.choice([*bodies, f"own {i}" * rng.randrange(300), None, ""])) for i in range(200)]
    return pages + [(300, None, bodies[0]), (301, "no url\r\nX: y%0A", "q"), (None, "http://a.org/1", bodies[0]), (5, pages[5][1], pages[5][2]), (302, "", "🙂" * 400)]


def test_round_trip_revisits_and_order(spark, tmp_path, monkeypatch):
    pages = corpus(1)
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    got = w.archive_and_index(frame, f"file://{tmp_path}/a", range_rows=40).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(plain(pages), key=str)
    got.sort(key=lambda r: (r.range, r.place))
    keys = [w.sort_key(r.urlkey, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and len({r.range for r in got}) > 1 and len({r.run for r in got}) == 3
    one = next(r for r in got if r.page_id == 302)
    data = (tmp_path / "a" / one.run).read_bytes()[one.offset : one.offset + one.length]
    assert w.parse(w.zlib.decompress(data, 31))["page_id"] == 302


def test_all_equal_runs_and_single_runs():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(9), k=rng.randrange(1, 12))) for _ in range(n)]
        keys, bounds = [k for r in runs for k in r], [0]
        for r in runs:
            bounds.append(bounds[-1] + len(r))
        assert [keys[i] for i in w.merge_runs(keys, bounds)] == sorted(keys)


def test_damage_is_found():
    data = bytearray(w.record(1, "http://a/", b"hello", None))
    assert w.parse(bytes(data))["payload_bytes"] == 5
    data[data.index(b"hello")] ^= 1
    try:
        w.parse(bytes(data))
        raise AssertionError("no error")
    except ValueError:
        pass


def test_members_over_pieces_and_files(tmp_path, monkeypatch):
    monkeypatch.setattr(w, "FILE_BYTES", 60)
    archive = w.Archive(f"file://{tmp_path}/x")
    bodies = [str(i).encode() * 50 for i in range(9)]
    for b in bodies:
        archive.add(b)
    archive.close()
    assert len(archive.files) > 1
    for piece in (1, 7, 1 << 20):
        assert [d for name, *_ in archive.files for *_, d in w.members(f"file://{tmp_path}/x", name, piece)] == bodies


def test_empty_table(spark, tmp_path):
    assert w.archive_and_index(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e").count() == 0


def test_any_page_id(spark, tmp_path):
    """Ids around the bounds of dates, negative and of 64 bits: all are captured, before page 0 if negative, in order of the ids."""
    ids = [-1, -259_200, -259_201, -(10**12), -(2**63), 0, 1, 251_824_463_999, 251_824_464_000, 251_824_723_199, 2**62, 2**63 - 1]
    pages = [(k, "http://a.org/", "z" * 1200 if k % 2 else f"own {k}") for k in ids]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = w.archive_and_index(frame, f"file://{tmp_path}/n", range_rows=5).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(plain(pages))
    got.sort(key=lambda r: (r.range, r.place))
    assert [r.page_id for r in got] == sorted(ids)
    times = {r.page_id: r.captured for r in got}
    assert times[0] == "20200101000000" and times[-1] == "20191231235959" and times[-(2**63)] == "00010101000000" and times[2**62] == "99991231235959"
