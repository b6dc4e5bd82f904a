import gzip
import io
import json
import os
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from logsieve.api import analyze
from logsieve.operators import aggregates as A, behavior as B, filterlang as FL, parse, path_rules, query, rules, scoring, windows
from logsieve.sinks import export, reports
from logsieve.sources import archives, discover, formats
from logsieve.streaming import streams
from logsieve.thresholds import Thresholds


def line(ip="10.0.0.1", when="01/Jan/2026:00:00:00 +0000", request="GET / HTTP/1.1", status=200, size="5", ua="curl/8"):
    return f'{ip} - - [{when}] "{request}" {status} {size} "-" "{ua}"'


def parsed(spark, lines, fmt=parse.BUILT_IN[0]):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "row long, value string")
    return parse.enriched(parse.entries(df, fmt).filter("ok").drop("ok")).withColumn("source", F.lit("t")).withColumn("line", F.col("row") + 1)


def test_parse_cases(spark):
    lines = [
        line(), line(request="get /a b c HTTP/2"), line(size="-"), line(request="GET HTTP/1.1"), line(request="BREW /x HTTP/1.1"), line(status=999), line(size="-4"), line(ip="::1", ua="-"),
        "nonsense", "", line(request="GET /x FTP/1"), line(size="12abc"),
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "row long, value string")
    got = [(r.row, r.ok, r.target if r.ok else None, r.bytes if r.ok else None) for r in parse.entries(df, parse.BUILT_IN[0]).orderBy("row").collect()]
    assert got == [(0, True, "/", 5), (1, True, "/a b c", 5), (2, True, "/", None), (3, True, "HTTP/1.1", 5), (4, False, None, None), (5, False, None, None), (6, False, None, None), (7, True, "/", 5),
                   (8, False, None, None), (9, False, None, None), (10, False, None, None), (11, True, "/", 12)]


def test_custom_format(spark):
    pattern = r"^(?<ip>[^|]+)\|(?<ts>[^|]+)\|(?<m>[^|]+)\|(?<t_x>[^|]+)\|(?<p>[^|]+)\|(?<st>\d+)$"
    config = {"formats": [{"name": "pipe", "pattern": pattern, "fields": {"ip": "ip", "timestamp": "ts", "method": "m", "target": "t_x", "protocol": "p", "status": "st"}}]}
    fmt = formats.parse_config(config)[0]
    r = parsed(spark, ["1.2.3.4|2026-01-01T00:00:00Z|GET|/a?x=1|HTTP/1.1|200", "bad"], fmt).collect()
    assert [(x.ip, x.epoch, x.path, x.status, x.bytes) for x in r] == [("1.2.3.4", 1767225600, "/a", 200, None)]
    for broken in ({}, {"formats": []}, {"formats": [{"name": "a b", "pattern": "x", "fields": {}}]}, {"formats": [{"name": "a", "pattern": "x", "fields": {"ip": "i", "timestamp": "t", "status": "s"}}]}):
        with pytest.raises(formats.FormatError):
            formats.parse_config(broken)


@pytest.mark.parametrize("bad", ["(a", "a)", "status:", "NOT", "a OR", '"open', "a AND"])
def test_filter_errors(bad):
    assert FL.validate_filter(bad)[0] is False


def test_filter_against_plain_python(spark):
    lines = [
        line(f"10.0.0.{i % 7}", request=f"{['GET', 'POST'][i % 2]} /p{i % 5}?q=a+b{i % 3}&x={i % 4} HTTP/1.1", status=[200, 301, 404, 500][i % 4], size=["-", "100", "2500"][i % 3], ua=["curl/8", "Big Bot/1", "-"][i % 3])
        for i in range(60)
    ]
    log = parse.access_log(parsed(spark, lines)).cache()
    rows = [r.asDict() for r in log.collect()]
    atoms = {
        "status:4xx": lambda r: r["status"] // 100 == 4, "bytes>=100": lambda r: r["bytes"] is not None and r["bytes"] >= 100, "bytes!=100": lambda r: r["bytes"] != 100,
        "ip=10.0.0.3": lambda r: r["ip"] == "10.0.0.3", "ua:*bot*": lambda r: "bot" in (r["userAgent"] or "").lower(), "path:p1": lambda r: "p1" in r["path"],
        'param:"q=a b1"': lambda r: "q=a+b1" in r["target"], "param:x": lambda r: True, "param!=x=2": lambda r: "x=2" not in r["target"], "method!=get": lambda r: r["method"] != "GET",
        "line<10": lambda r: r["lineNumber"] < 10, "zzz": lambda r: False, "ua!=curl/8": lambda r: (r["userAgent"] or "") != "curl/8",
    }
    rnd = random.Random(5)

    def make(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(list(atoms.items()))
        kind = rnd.choice(["and", "or", "not", "side"])
        a, f = make(depth - 1)
        if kind == "not":
            return f"NOT ({a})", lambda r: not f(r)
        b, g = make(depth - 1)
        if kind == "or":
            return f"({a} {rnd.choice(['OR', '|'])} {b})", lambda r: f(r) or g(r)
        return f"({a}){' AND ' if kind == 'and' else ' '}({b})", lambda r: f(r) and g(r)

    made = [make(3) for _ in range(25)]
    flags = log.select("row", *[FL.compile_filter(q).alias(f"f{i}") for i, (q, _) in enumerate(made)]).collect()
    by_row = {r["row"]: r for r in rows}
    for flag in flags:
        for i, (q, f) in enumerate(made):
            assert flag[f"f{i}"] == f(by_row[flag["row"]]), q


def test_runs_against_fold(spark):
    rnd = random.Random(2)
    rows = [(k, e) for k in "abcde" for e in sorted(rnd.sample(range(60), 35))]

    def fold(seconds):
        best, start, last = (0, 0, 0), None, None
        for e in seconds:
            start = start if last is not None and e == last + 1 else e
            last = e
            if e - start + 1 > best[0]:
                best = (e - start + 1, start, e)
        return best

    got = {r.k: (r.run_seconds, r.run_start, r.run_end) for r in windows.longest_run(spark.createDataFrame(rows, "k string, epoch long"), ["k"]).collect()}
    assert got == {k: fold([e for x, e in rows if x == k]) for k in "abcde"}


def test_p95_zero_filled(spark):
    rnd = random.Random(4)
    for n in (1, 5, 30):
        seconds = {e: rnd.randint(1, 9) for e in rnd.sample(range(40), n)}
        a, b = min(seconds), max(seconds)
        values = sorted(seconds.get(e, 0) for e in range(a, b + 1))
        want = values[int((len(values) - 1) * 0.95)]
        assert A.p95(spark.createDataFrame(list(seconds.items()), "epoch long, n long")).first().p95 == want


HITS = [
    ("/x?id=1%20union%20select%20a", ["sqli"]), ("/x?id=1+union+select+a", []), ("/x?q=%3Cscript%3E", ["xss"]), ("/a/../b", ["lfi_rfi"]), ("/f?url=http://169.254.169.254/", ["ssrf"]), ("/p?h=1;id", ["command_injection"]),
    ("/.env", ["recon_sensitive_file"]), ("/.environment", []), ("/db.zip", []), ("/asset-0x1234.js", []), ("/blog/foo--bar", []), ("/x?c=$IFS", []), ("/.git/config", ["recon_sensitive_file"]), ("/ok", []),
]


def test_signatures(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HITS)], "i long, target string")
    got = [r.r for r in df.select("i", rules.rule_ids(F.col("target"), F.lit("GET")).alias("r")).orderBy("i").collect()]
    assert got == [w for _, w in HITS]
    assert spark.range(1).select(rules.rule_ids(F.lit("/ok"), F.lit("TRACE")).alias("r")).first().r == ["rare_method"]
    assert spark.range(1).select(rules.rule_ids(F.lit("/db.zip"), F.lit("GET"), strict_gate=False).alias("r")).first().r == ["recon_sensitive_file"]


STATS = "path string, count long, uniqueIps long, repeatedIps long, repeatedRequests long, queryVariants long, status2xx long, status3xx long, status4xx long, status5xx long, maxServedPerMinute long, maxRequestsPerMinute long"
PATHS = [
    (("/hot", 1000, 20, 20, 1000, 250, 1000, 0, 0, 0, 0, 0), (True, None)),
    (("/trail", 10000, 50, 50, 10000, 5000, 10000, 0, 0, 0, 120, 0), (True, "query_churn")),
    (("/api/search", 12500, 50, 50, 12500, 6500, 10000, 0, 0, 2500, 0, 0), (True, "query_churn")),
    (("/producto/123", 12500, 25, 25, 12500, 1, 12500, 0, 0, 0, 120, 0), (True, "repeat_pressure")),
    (("/producto/9", 12500, 10000, 0, 0, 0, 12500, 0, 0, 0, 120, 0), (False, None)),
    (("/running", 70708, 1103, 1103, 70708, 69582, 12, 0, 70696, 0, 0, 0), (True, None)),
    (("/", 99999, 500, 500, 99999, 9999, 99999, 0, 0, 0, 500, 500), (False, None)),
]


def test_saturation_matrix(spark):
    df = spark.createDataFrame([x for x, _ in PATHS], STATS).withColumn("postCount", F.lit(0)).withColumn("bytes", F.lit(0))
    got = {r.path: (r.crawl, r.saturation) for r in path_rules.signals(df).collect()}
    assert got == {x[0]: w for x, w in PATHS}


def test_sticky_bot_and_burst(spark):
    lines = [line(ua="GPTBot/1.0"), line(ua="Firefox/1", request="GET /robots.txt HTTP/1.1"), line("10.0.0.2", ua="x")]
    lines += [line("9.9.9.9", f"01/Jan/2026:00:00:0{s} +0000") for s in (1, 2, 3) for _ in range(50)]
    e = parsed(spark, lines).cache()
    bots = A.bot_rollup(e, A.known_actors(e)).collect()
    assert [(b.botName, b.requests, b.requestedRobotsTxt) for b in bots] == [("GPTBot", 2, True)]
    assert [(r.ip, r.run_seconds) for r in B.bursts(e).collect()] == [("9.9.9.9", 3)]


def test_scoring(spark):
    from logsieve.operators import incidents as I

    df = spark.createDataFrame([("a:1", "x", "noise", 70, "1.1.1.1"), ("b:1", "ddos", "saturation", 90, "1.1.1.1"), ("c", "x", "noise", 24, None)], "id string, cat string, kind string, score int, ip string")
    found = I.build(df, F.col("id"), F.col("cat"), F.col("kind"), "low", F.col("score"), "t", "d", [I.text("ip", F.col("ip"))], ip=F.col("ip"), requests=F.lit(100_000), begin=F.lit(0), end=F.lit(1800))
    got = {r.id: (r.score, r.severity) for r in scoring.scored(found).collect()}
    assert got == {"a:1": (95, "critical"), "b:1": (100, "critical"), "c": (39, "low")}


def test_files_reports_and_export(spark, tmp_path):
    one = "\n".join([line(f"10.0.0.{i}", f"01/Jan/2026:00:00:{i:02d} +0000", f"GET /p?i={i} HTTP/1.1") for i in range(6)] + ["junk", "", line(request="GET /.env HTTP/1.1", status=200), line(request="GET /.env HTTP/1.1", status=200)]) + "\n"
    two = "\r\n".join(line("10.1.1.1", request="GET /a|b?x=<i> HTTP/1.1") for _ in range(3)) + "\r\n"
    (tmp_path / "a.log").write_text(one)
    with gzip.open(tmp_path / "b.log.gz", "wt", newline="") as f:
        f.write(two)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("logs/access.log", two)
        z.writestr("__MACOSX/x.log", "no")
    with tarfile.open(tmp_path / "d.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("x.log.gz")
        data = gzip.compress(two.encode())
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    result = analyze(spark, [str(tmp_path)], top=3)
    report = result.report()
    assert report["summary"] == {"files": 4, "totalLines": 18, "parsedLines": 17, "filteredLines": 0, "invalidLines": 1, "totalBytes": 85}
    assert [i["format"] for i in report["inputFormats"]] == ["apache_combined"] * 4 and report["inputFormats"][2]["file"].endswith("c.zip::logs/access.log")
    rows = [(r.row, r.lineNumber) for r in result.analysis.log.orderBy("row").collect()]
    assert [r for r, _ in rows] == list(range(17)) and rows[7] == (7, 9) and rows[8] == (8, 1)
    assert report["topIps"][0] == {"value": "10.1.1.1", "count": 9}
    env = next(i for i in report["incidents"] if i["id"] == "recon_sensitive_file:10.0.0.1")
    assert env["kind"] == "compromise" and env["successful"] and {"key": "topPaths", "value": "/.env"} in env["evidence"]
    assert next(m for m in report["incidentMatches"] if m["incidentId"] == env["id"])["rowNumbers"] == [6, 7]
    json.loads(reports.to_json(report))
    assert "a\\|b" in reports.to_markdown(report) and "&lt;" not in reports.to_terminal(report) and "<script" not in reports.to_html(report)
    target = str(tmp_path / "out.csv")
    assert export.export(result.analysis.log.filter(FL.compile_filter("ip:10.1")).orderBy("row"), target, "csv") == 9
    assert open(target).read().splitlines()[0] == "row,source,lineNumber,timestamp,ip,method,target,path,status,bytes,userAgent,raw"
    assert export.cell('a"b,c', ",") == '"a""b,c"' and export.cell(None, ",") == ""
    filtered = analyze(spark, [str(tmp_path / "a.log")], since="2026-01-01T00:00:03Z").report(False)["summary"]
    assert (filtered["parsedLines"], filtered["filteredLines"]) == (3, 5)


def test_rejects(spark, tmp_path):
    (tmp_path / "x.log").write_text('{"a": 1}\nstack trace\n')
    with pytest.raises(ValueError, match="not a log"):
        analyze(spark, [str(tmp_path / "x.log")])
    with pytest.raises(FileNotFoundError):
        discover.discover([str(tmp_path / "none")])
    assert [archives.is_candidate(n) for n in ("access", "a.log", "a.png", ".hidden", "__MACOSX/a.log", "my_access.dat", "x.br")] == [True, True, False, False, False, True, True]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [line("9.9.9.9", f"01/Jan/2026:00:00:0{s} +0000", status=404) for s in (1, 2, 3, 4) for _ in range(50)]
    (folder / "1.log").write_text("\n".join(rows) + "\n")
    (folder / "2.log").write_text(line("1.1.1.1", "01/Jan/2026:01:00:00 +0000") + "\n")
    (folder / "3.log").write_text(line("1.1.1.1", "01/Jan/2026:02:00:00 +0000") + "\n")
    for i, name in enumerate(("1.log", "2.log", "3.log")):
        os.utime(folder / name, (1_000_000 + i, 1_000_000 + i))

    def run(df, mode="append"):
        got = []
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / f"c{len(os.listdir(tmp_path))}")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return got

    make = lambda: streams.entries(spark, str(folder), files_per_trigger=1)
    assert {r.epoch - 1767225600: r.n for r in run(streams.rps(make()))} == {1: 50, 2: 50, 3: 50, 4: 50, 3600: 1}
    assert ("9.9.9.9", 200) in [(r.ip, r.most) for r in run(streams.storms(make(), 4))]
    assert max((r.run_seconds, r.run_start - 1767225600) for r in run(streams.bursts(make()))) == (4, 1)


def test_streams_of_subnets_and_all(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    at = lambda s: f"01/Jan/2026:00:{s // 60:02d}:{s % 60:02d} +0000"
    busy = [line(f"10.1.1.{i % 12}", at(s)) for s in range(10, 16) for i in range(210)] + [line("10.2.2.1", at(s)) for s in range(10, 16) for _ in range(210)]
    names = [("1", busy[::2]), ("2", busy[1::2]), ("3", [line("1.1.1.1", at(40 * 60))]), ("4", [line("1.1.1.1", at(1))] * 3), ("5", [line("1.1.1.1", at(59 * 60))])]
    for i, (name, rows) in enumerate(names):
        (folder / f"{name}.log").write_text("\n".join(rows) + "\n")
        os.utime(folder / f"{name}.log", (1_000_000 + i, 1_000_000 + i))

    def run(writer):
        q = writer.outputMode("append").option("checkpointLocation", str(tmp_path / f"c{len(os.listdir(tmp_path))}")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    def rows_of(df):
        got = []
        run(df.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())))
        return got

    make = lambda: streams.entries(spark, str(folder), files_per_trigger=1)
    found = rows_of(streams.subnet_bursts(make()))
    assert {r.subnet for r in found} == {"10.1.1.0/24"} and max(r.run_seconds for r in found) == 6  # the other has one address
    few = Thresholds(spike_rps=300, spike_seconds=5)
    assert sorted((r.run_start - 1767225600, r.run_end - 1767225600) for r in rows_of(streams.global_bursts(make(), few))) == [(10, 14), (11, 15)]
    counter, writer = streams.late_counter(make())
    run(writer)
    assert counter.late == 3 and counter.newest == 1767225600 + 59 * 60


def test_rows_by_number(spark):
    log = spark.createDataFrame([(i, f"v{i}") for i in range(7000)], "row long, v string")
    assert query.rows_at(log, list(range(6500))).count() == 6500 and query.rows_at(log, [3, 3, 9999]).count() == 1
    assert [[r.row for r in c] for c in query.chunks_at(log, [5, 2, 5, 6999], 3)] == [[5, 2, 5], [6999]]
    with pytest.raises(IndexError):
        list(query.chunks_at(log, [1, 7000]))
    with pytest.raises(InterruptedError):
        list(query.chunks_at(log, range(10), 4, stop=lambda: True))
    assert query.selection([1, 1, 2]) == [1, 2]
    with pytest.raises(ValueError):
        query.selection(list(range(5001)))


def test_arrival_runs(spark):
    """Against a fold over rows in order."""
    rnd = random.Random(12)
    for _ in range(5):
        rows = [(rnd.choice("ab"), max(0, i // 9 + rnd.choice([0, 0, 0, 0, 0, 0, 0, -1, 1])), i) for i in range(300)]
        want = {}
        for key in "ab":
            parts = []
            for _, epoch, _ in (r for r in rows if r[0] == key):
                if parts and parts[-1][0] == epoch:
                    parts[-1][1] += 1
                else:
                    parts.append([epoch, 1])
            best, run, last = None, [], None
            for epoch, n in parts:
                run = ([*run, epoch] if run and last == epoch - 1 else [epoch]) if n >= 2 else []
                last = epoch
                if run and (best is None or len(run) > best[0]):
                    best = (len(run), run[0], run[-1])
            want[key] = best
        got = {r.k: (r.run_seconds, r.run_start, r.run_end) for r in windows.arrival_runs(spark.createDataFrame(rows, "k string, epoch long, row long"), "k", 2).collect()}
        assert got == {k: v for k, v in want.items() if v}


def test_runs_cross_midnight(spark):
    seconds = [86_390 + i for i in range(20)] + [200_000 + i for i in range(12)] + [3 * 86_400 - 1, 3 * 86_400]
    frame = spark.createDataFrame([(s,) for s in seconds], "epoch long")
    assert tuple(windows.longest_run(frame, []).first()) == (20, 86_390, 86_409)
    keyed = frame.selectExpr("'x' as ip", "epoch").unionByName(spark.createDataFrame([("y", 5)], "ip string, epoch long"))
    assert {tuple(r) for r in windows.longest_run(keyed, ["ip"]).collect()} == {("x", 20, 86_390, 86_409), ("y", 1, 5, 5)}


def test_display():
    from logsieve.sinks import display as d

    assert [d.size(n) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.0 KiB", "3.0 MiB", "5.0 GiB"]
    assert d.when("15/Jan/2024:14:30:00 +0000") == "15/Jan 14:30:00" and d.when("2024-01-15T14:30:00.000Z") == "01-15 14:30:00" and d.when("x" * 20) == "x" * 15
    assert [d.fitted("a  b\nc", w) for w in (0, 3, 5)] == ["", "a b", "a b c"] and d.fitted("abcdefgh", 6) == "abc..."
    assert d.wrapped("abcde", 2) == ["ab", "cd", "e"] and d.file_part(" /a b?/") == "a_b" and d.file_part("//") == "unknown"


def test_storage_and_export(spark, tmp_path, monkeypatch):
    from logsieve import cli, stored
    from logsieve.sinks import export

    kept = stored.keep(spark.range(3), "sweep-test")
    assert stored.sweep(spark, older_than_hours=-1) >= 0 and kept.count() == 3  # what this process made stays
    log = spark.range(6000).selectExpr(*[f"id as {c}" for c in export.COLUMNS])
    with pytest.raises(InterruptedError):
        export.export(log, str(tmp_path / "x.csv"), "csv", stop=lambda: True)
    assert not list(tmp_path.iterdir())
    assert '"lines": [' in export.pretty(log.limit(1).collect())
    with pytest.raises(SystemExit) as e:
        cli.parser().parse_args(["--version"])
    assert e.value.code == 0
    for bad in (["--top", "0"], ["--since", "soon"], ["--json", "--html"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)


def test_large_archives_are_read_from_storage(spark, tmp_path, monkeypatch):
    from logsieve.sources import archives

    monkeypatch.setattr(archives, "WHOLE", 10)
    for ending in (".zip", ".tar.gz"):
        path = str(tmp_path / f"a{ending}")
        archives.write_archive(path, "logs/access.log", [f"line {i}" for i in range(20_000)])
        rows = archives.read_archives(spark, [path]).collect()
        assert [r.value for r in sorted(rows, key=lambda r: r.place)] == [f"line {i}" for i in range(20_000)]


def long_addresses(spark, folder):
    """Events of users of one to six digits: the log's IPv6 addresses of 10013 and more have a group of five digits, which is not valid."""
    users = [0, 17, 3400, 9996, 10013, 10013, 10030, 89998, 100011, 1, 27]
    rows = [(4 * i + j, u, "view", 1.5) for i, u in enumerate(users) for j in (0, 2)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")


def same_as_sql(spark, folder, name):
    import duckdb

    import __spark_entry__ as entry

    c = duckdb.connect()
    c.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    c.execute(f"create table wanted as {entry.oracle_sql()[name]}")
    names = [x[0] for x in c.execute("describe wanted").fetchall()]
    got = [tuple(r[n] for n in names) for r in entry.queries()[name](spark, str(folder)).collect()]
    assert sorted(got, key=str) == sorted(c.execute("select * from wanted").fetchall(), key=str)
    return got


def test_subnet_seconds_of_long_addresses(spark, tmp_path):
    long_addresses(spark, tmp_path)
    got = same_as_sql(spark, tmp_path, "subnet_seconds")
    assert sum(r[2] for r in got) == 22 and "2001:db8:10013::/48" in {r[0] for r in got}
    valid = A.subnet_seconds(parsed(spark, [line("2001:db8:10013::1"), line("2001:db8:9996::1"), line("host")])).collect()
    assert [(r.subnet, r.n, r.ips) for r in valid] == [("2001:db8:9996::/48", 1, 1)]  # the engine's own rule, as before


def test_subnets_of_long_addresses(spark, tmp_path):
    long_addresses(spark, tmp_path)
    got = dict(same_as_sql(spark, tmp_path, "subnets"))
    assert None not in got and got["2001:db8:10013::/48"] == 4 and got["2001:db8:9996::/48"] == 2
