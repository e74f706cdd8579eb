"""WARC archives and url filters on small fixtures."""

import hashlib
import io
import time
import zlib

import numpy as np

from pyspark.sql import functions as F

from popweave.llm import url_filters, warc

SCHEMA = "page_id long, url string, html string, lang string, host string"
BODY = "<html>" + "ä" * 120


def pages(spark, rows):
    return spark.createDataFrame([(*r, "en", "other") for r in rows], SCHEMA)


def test_archives_round_trip(spark, tmp_path):
    rows = [(5, "http://a.net/x", BODY), (2, "http://b.net/%0A\r\ny", BODY), (9, None, BODY), (3, "u", "short"), (4, "u", "short"), (6, "http://c/", None), (7, "http://d/", "z" * 100), (8, "http://d/", "z" * 100), (8, "http://d/", "z" * 100), (None, "n", BODY)]
    df = pages(spark, rows)
    files = warc.write_warc(warc.resolve(df), f"file://{tmp_path}/w")
    got = warc.read_warc(files)
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r)
    assert sum(map(len, by.values())) == len(rows)
    for page, url, html in rows:
        r = by[page][0]
        raw = (html or "").encode()
        assert r.url == url and r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
        assert r.record_type == ("revisit" if page in (5, 9, 8, None) else "response")
        assert r.payload == (None if r.record_type == "revisit" else raw)
    refers = {(r.page_id, r.refers_to) for r in warc.with_responses(got).collect()}
    assert refers == {(5, 2), (2, None), (9, 2), (3, None), (4, None), (6, None), (7, None), (8, 7), (None, 2)}
    assert warc.write_warc(warc.resolve(df.limit(0)), f"file://{tmp_path}/e").count() == 0


def test_rules(spark):
    urls = {
        "http://A.Net/x": ("a.net", "/x", "net/", "block"), "https://m.example.net/en/1?q#f": ("m.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://x.org/fr/a": ("x.org", "/fr/a", "org/fr/", "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://net": ("net", "", None, "block"), "http://internet/": ("internet", "/", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://u.org?x=://y/": ("u.org", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    df = pages(spark, [(i, u, None) for i, u in enumerate(urls)] + [(99, "http://net/1", None)])
    got = {r.page_id: r for r in url_filters.judge(df).collect()}
    for i, (url, want) in enumerate(urls.items()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, url
    assert url_filters.judge(df.limit(0)).count() == 0


def test_propagation_against_the_linear_system(spark):
    link = lambda *hosts: "".join(f"<a href='https://{h}/p'>x</a>" for h in hosts)
    rows = [
        (1, "http://bad.net/", link("spam.io", "spam.io")), (2, "http://spam.io/", link("bad.net")), (3, "http://farm.io/", link("BAD.net", "spam.io")),
        (4, "http://good.org/fr/", link("fine.io")), (5, "http://fine.io/", link("good.org", "other.io")), (6, "http://lone.io/", "<a href='/self'>"),
    ]
    got = {r.host: r for r in url_filters.judge(pages(spark, rows)).collect()}
    assert got["farm.io"].verdict == "block"
    assert got["fine.io"].verdict == got["lone.io"].verdict == "allow"
    edges = {("bad.net", "spam.io"): 2, ("spam.io", "bad.net"): 1, ("farm.io", "bad.net"): 1, ("farm.io", "spam.io"): 1, ("good.org", "fine.io"): 1, ("fine.io", "good.org"): 1, ("fine.io", "other.io"): 1}
    hosts = sorted({h for e in edges for h in e} | {"lone.io"})

    def rank(seed, ahead=True):
        flow = {(a, b) if ahead else (b, a): n for (a, b), n in edges.items()}
        out = {h: sum(n for (a, _), n in flow.items() if a == h) for h in hosts}
        s, move = np.array([seed.get(h, 0.0) for h in hosts]), np.zeros((len(hosts), len(hosts)))
        for (a, b), n in flow.items():
            move[hosts.index(b), hosts.index(a)] = n / out[a]
        for k, h in enumerate(hosts):
            if not out[h]:
                move[:, k] = s  # what ends there goes back to the seeds
        return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - 0.85 * move, 0.15 * s), strict=True))

    pages_ = {h: 1 / 6 for h in ("bad.net", "spam.io", "farm.io", "good.org", "fine.io", "lone.io")}
    t, d, p = rank({"good.org": 1.0}), rank({"bad.net": 1.0}, False), rank(pages_)
    for h, r in got.items():
        assert abs(r.spam_share - d[h] / (t[h] + d[h] + p[h])) < 1e-5


def test_reading_is_linear():
    def archive(n):
        out = io.BytesIO()
        for k in range(n):
            body = np.random.default_rng(k).bytes(1500)
            head = f"WARC/1.1\r\nPage-ID: {k}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
            pack = zlib.compressobj(1, zlib.DEFLATED, 31)
            out.write(pack.compress(head + body + b"\r\n\r\n") + pack.flush())
        return out.getvalue()

    data = archive(20_000)  # some 33 MB
    began = time.time()
    got = list(warc.parse(io.BytesIO(data)))
    assert time.time() - began < 20 and [int(f["Page-ID"]) for f, _ in got] == list(range(20_000))
    assert got[7][1] == np.random.default_rng(7).bytes(1500)
    try:
        list(warc.parse(io.BytesIO(data[:-100])))
        raise AssertionError("a cut archive must be seen")
    except ValueError:
        pass


def test_odd_pages(spark, tmp_path):
    rows = [(1, "http://a.net/", ""), (1, "http://a.net/", ""), (None, None, None), (2, "http://b.org/fr/", "x" * 3_000_000), (3, "http://c.io/", "<a href='//b.org/x'>" * 1000)]
    df = pages(spark, rows)
    for name in ("payload_bytes", "payload_digest", "refers_to", "p", "d", "rule", "verdict", "_action", "allowed", "spam_share"):
        df = df.withColumn(name, F.lit(1))
    got = warc.read_warc(warc.write_warc(warc.resolve(df), f"file://{tmp_path}/o")).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type) for r in got) == [(0, 0, "response"), (1, 0, "response"), (1, 0, "response"), (2, 3_000_000, "response"), (3, 20_000, "response")]
    judged = url_filters.judge(df).collect()
    assert len(judged) == 5 and {(r.page_id, r.verdict) for r in judged} >= {(1, "block"), (2, "allow"), (None, "allow")}
