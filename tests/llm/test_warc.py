"""WARC records and their assembly."""

import gzip
import random
import time

from textloom.llm import warc as W

URL, DATE = "http://a.example/x", "2024-01-01T00:00:00Z"


def rec(i, kind, to=(), block=b"", date=DATE):
    return {"record_id": i, "warc_type": kind, "target_uri": URL, "warc_date": date, "concurrent_to": list(to), "content_type": "text/plain", "block": block}


def frame(spark, rows):
    names = [f.split()[0] for f in W.RECORD.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) + ("z",) for r in rows], W.RECORD + ", tl_first string")


def ids(row):
    x = [row.request, row.response, *row.metadata, *row.others]
    return frozenset(r.record_id for r in x if r is not None)


def test_round_trip_and_files(spark, tmp_path):
    rows = [rec("<a>", "response", block=b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1 inside \xff"), rec("<b>", "request", ["<a>", "<c>"]), rec("<c>", "warcinfo", block="é".encode())]
    for zipped in (False, True):
        data = b"".join(W.serialise(r, zipped) for r in rows)
        assert list(W.parse(data)) == rows
        (tmp_path / f"x{zipped}.warc").write_bytes(data)
    (tmp_path / "empty.warc").write_bytes(b"")
    read = W.read_warc(spark, str(tmp_path))
    assert sorted(r.record_id for r in read.collect()) == ["<a>", "<a>", "<b>", "<b>", "<c>", "<c>"]
    assert [r["error"] for r in W.parse(b"WARC/1.0\r\nContent-Length: x\r\n\r\n")] == ["Content-Length 'x'"]


def damaged(rows, k, zipped, how):
    parts = [W.serialise(r, zipped) for r in rows]
    parts[k] = how(parts[k])
    return list(W.parse(b"".join(parts)))


def test_damage_costs_only_what_is_damaged(spark, tmp_path):
    rows = [rec(f"<{k}>", "response", block=bytes([65 + k]) * 3000 + b"\r\n") for k in range(5)]
    names = lambda got: [r["record_id"] for r in got if "error" not in r]
    errors = lambda got: [r["error"] for r in got if "error" in r]
    for how in (lambda x: x.replace(b"Length: 3002", b"Length: many"), lambda x: x.replace(b"Length: 3002", b"Length: 99999999"), lambda x: x.replace(b"Length: 3002", b"Length: 30"), lambda x: x.replace(b"Content-Length: 3002\r\n", b""), lambda x: x[:200], lambda x: x[:-1000]):
        got = damaged(rows, 2, False, how)
        assert names(got) == ["<0>", "<1>", "<3>", "<4>"] and len(errors(got)) == 1
    flip = lambda x: x[:30] + bytes([x[30] ^ 0xFF]) + x[31:]
    got = damaged(rows, 2, True, flip)
    assert names(got) == ["<0>", "<1>", "<3>", "<4>"] and errors(got)
    got = damaged(rows, 4, True, lambda x: x[:-12])
    assert names(got) == ["<0>", "<1>", "<2>", "<3>"] or errors(got)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(flip(W.serialise(r, True)) if k == 1 else W.serialise(r, True) for k, r in enumerate(rows)))
    read = W.read_warc(spark, str(tmp_path))
    assert sorted(r.record_id for r in read.where("error is null").collect()) == ["<0>", "<2>", "<3>", "<4>"]
    assert read.where("error is not null").count() >= 1
    assert W.assemble(read).count() == 4


def test_reading_is_linear_and_holds_little():
    one = W.serialise(rec("<x>", "response", block=b"x" * 20_000), True)
    took = []
    for n in (500, 4000):
        data = one * n
        began = time.process_time()
        assert sum(1 for _ in W.parse(data)) == n
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0] + 0.5
    whole = gzip.compress(W.serialise(rec("<x>", "response", block=b"y" * 50_000)) * 200)
    assert sum(len(r["block"]) for r in W.parse(whole)) == 200 * 50_000


def brute(rows):
    """Captures by following every identifier; the contents of each as plain tuples."""
    link = {}

    def root(x):
        while link.setdefault(x, x) != x:
            x = link[x]
        return x

    for n, r in enumerate(rows):
        own = r["record_id"] if r["record_id"] is not None else ("none", n)
        for t in r["concurrent_to"] or []:
            if t is not None:
                link[root(own)] = root(t)
    groups = {}
    for n, r in enumerate(rows):
        if r["record_id"] is not None or any(t is not None for t in r["concurrent_to"] or []):
            groups.setdefault(root(r["record_id"] if r["record_id"] is not None else ("none", n)), set()).add(tuple(r[k] for k in ("warc_date", "record_id", "warc_type", "target_uri", "content_type", "block")))
    nulls_first = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    out = []
    for name, g in groups.items():
        rs = sorted(g, key=nulls_first)
        ids = [r[1] for r in rs if r[1] is not None] or [x for x in link if isinstance(x, str) and root(x) == name]
        of = lambda kind, rs=rs: [r for r in rs if (r[2] or "") == kind]
        req, res, meta = of("request"), of("response"), of("metadata")
        rest = [r for r in rs if (r[2] or "") not in ("request", "response", "metadata")]
        out.append((res[0][1] if res and res[0][1] is not None else min(ids), res[0][3] if res and res[0][3] is not None else rs[0][3], len(rs), req[0] if req else None, res[0] if res else None, meta, req[1:] + res[1:] + rest))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_contents_against_a_search(spark):
    """Ties between responses and requests, repeated rows, long bodies, nulls: the whole of every row."""
    rng = random.Random(9)
    rows = []
    for k in range(50):
        main = f"r{k:02}"
        for j in range(rng.choice([1, 1, 1, 2, 3])):
            rows.append(rec(main if not j else f"{main}-{j}", "response", [main] if j else [], rng.choice([None, b"", b"body", b"z" * 200_000 if k == 3 else b"q"]), rng.choice([DATE, "2023-01-01", None])))
        for j in range(rng.choice([0, 1, 2])):
            rows.append({**rec(f"{main}q{j}", "request", [main], b"GET"), "target_uri": rng.choice([URL, None])})
        for j in range(rng.choice([0, 1, 2])):
            rows.append(rec(rng.choice([None, f"{main}m{j}"]), "metadata", [rng.choice([main, f"{main}q0"])], rng.choice([b"m1", b"m2"])))
        if rng.random() < 0.3:
            rows.append(rec(f"{main}x", rng.choice(["revisit", None, "warcinfo"]), [main]))
    rows += rows[:20]
    plain = lambda s: None if s is None else tuple(bytes(x) if isinstance(x, bytearray) else x for x in s)
    got = [(r.capture_id, r.target_uri, r.n_records, plain(r.request), plain(r.response), [plain(x) for x in r.metadata], [plain(x) for x in r.others]) for r in W.assemble(frame(spark, rows).repartition(5)).collect()]
    assert sorted(got, key=lambda r: (r[0], r[2])) == brute(rows)


def test_capture(spark):
    rows = [rec("r1", "response", block=b"body"), rec("q1", "request", ["r1"]), rec("m1", "metadata", ["r1"]), rec("m2", "metadata", ["r1"]), rec("r2", "response")]
    got = {r.capture_id: r for r in W.assemble(frame(spark, rows + rows[:2])).collect()}
    assert set(got) == {"r1", "r2"}
    r = got["r1"]
    assert (r.n_records, r.request.record_id, bytes(r.response.block), [m.record_id for m in r.metadata], r.others) == (4, "q1", b"body", ["m1", "m2"], [])
    assert got["r2"].request is None and got["r2"].metadata == []


def test_chains_against_a_search(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        names = [f"x{k:02}-{j}" for j in range(rng.randrange(1, 6))]
        for j, n in enumerate(names):
            to = [rng.choice(names[:j])] if j else []
            to += [rng.choice(names) for _ in range(rng.choice([0, 0, 1, 2]))] + rng.choice([[], [], [f"absent{k % 7}"]] if k > 40 else [[]])
            rows.append(rec(n, rng.choice(["request", "response", "metadata", "revisit", None]), rng.sample(to, len(to))))
    link = {}

    def root(x):
        while link.setdefault(x, x) != x:
            x = link[x]
        return x

    for r in rows:
        for t in r["concurrent_to"]:
            link[root(t)] = root(r["record_id"])
    groups = {}
    for r in rows:
        groups.setdefault(root(r["record_id"]), set()).add(r["record_id"])
    got = W.assemble(frame(spark, rows)).collect()
    assert sorted(map(sorted, map(ids, got))) == sorted(map(sorted, groups.values()))
    assert all(r.n_records == len(ids(r)) for r in got)


def test_nulls_and_empty(spark):
    rows = [rec(None, "metadata", ["r1"]), rec("r1", "response"), rec(None, "request"), rec("r3", None, [None]), {**rec("r4", "response", block=None), "concurrent_to": None, "target_uri": None}]
    got = {r.capture_id: r for r in W.assemble(frame(spark, rows)).collect()}
    assert set(got) == {"r1", "r3", "r4"} and len(got["r1"].metadata) == 1 and got["r3"].others[0].record_id == "r3"
    assert W.assemble(frame(spark, rows[:0])).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://h.example/p?q=1#f", "<p>é</p>"), (2, None, None), (None, "http://x", "y")], "page_id long, url string, html string")
    got = {r.capture_id: r for r in W.assemble(W.records_of_pages(pages)).collect()}
    assert len(got) == 2
    r = got["<urn:textloom:response:1>"]
    assert bytes(r.request.block) == b"GET /p?q=1 HTTP/1.1\r\nHost: h.example\r\n\r\n"
    assert bytes(r.response.block).endswith("Content-Length: 9\r\n\r\n<p>é</p>".encode())
    assert len(r.metadata) == 1 and r.others == []
