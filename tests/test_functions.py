"""Table-driven tests for the scalar rules the reference leaves untested."""

from pyspark.sql import functions as F

from fleetscope.functions import auth, logtext


def one(spark, col, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_classifier(spark):
    lines = [
        "Failed password for root from 1.2.3.4 port 22 ssh2",
        "Failed password for invalid user bob from 5.6.7.8 port 22 ssh2",
        "Invalid user eve from 9.9.9.9",
        "Accepted publickey for deploy from 10.0.0.1 port 22 ssh2",
        "Connection closed by authenticating user root 1.1.1.1 port 22 [preauth]",
        "something else",
    ]
    out = one(spark, auth.classify(F.col("x")), lines)
    assert [(o.action, o.username, o.source_ip) if o else None for o in out] == [
        ("Failed Login", "root", "1.2.3.4"), ("Failed Login", "bob", "5.6.7.8"),
        ("Invalid User", "eve", "9.9.9.9"), ("Login Accepted", "deploy", "10.0.0.1"),
        ("Connection Closed", "root", "1.1.1.1"), None]


def test_extractors(spark):
    lines = ["Failed password for invalid user x from 1.2.3.4 port 1", "Invalid user y from 2.2.2.2", "nothing"]
    assert one(spark, auth.attacker_ip(F.col("x")), lines) == ["1.2.3.4", "", ""]
    assert one(spark, auth.target_user(F.col("x")), lines) == ["x", "y", None]


def test_severity(spark):
    lines = ["kernel: CRITICAL disk", "an error occurred", "Warning: low", "INFO started", "debug x",
             "ERRORS are not words", "fatal and error", "plain", "éerror: accented neighbour", "x_error"]
    # an accented letter is not a word character for the class patterns; '_' is
    assert one(spark, logtext.severity(F.col("x")), lines) == [
        "critical", "error", "warn", "info", "debug", "other", "critical", "other", "error", "other"]


def test_metric_names(spark):
    valid = ["cpu_usage_percent", "ab", "a1", "a_b", "cpu_seconds_total", "http_requests_total"]
    invalid = ["", "_starts_under", "1starts_digit", "CamelCase", "kebab-case", "dot.separated", "trailing_",
               "CPU", "a", "has space", "cpu\n"]
    assert all(one(spark, logtext.valid_metric_name(F.col("x")), valid))
    assert not any(one(spark, logtext.valid_metric_name(F.col("x")), invalid))


def test_log_name(spark):
    assert one(spark, logtext.log_name(F.col("x")), ["/var/log/auth.log", "/var/log/nginx/a.log",
                                                     "/opt/app/x.log"]) == ["auth.log", "nginx/a.log", "x.log"]


def test_health_rules(spark):
    from fleetscope.operators import fleet
    cases = [  # cpu, mem, disk, mem_trend, mem_projection, cpu_baseline, anomalies -> state, headline
        (None, None, None, "stable", None, None, 0, "critical", "offline — no metric collection."),
        (85.5, 50.0, 10.0, "stable", None, 40.0, 0, "critical", "CPU critical at 86%."),
        (84.5, 50.0, 10.0, "stable", None, 40.0, 0, "critical", "CPU critical at 84%."),
        (10.0, 95.0, 10.0, "stable", None, 9.0, 0, "critical", "memory critical at 95%."),
        (10.0, 60.0, 10.0, "up", "90% in ~3h", 9.0, 0, "attention", "memory rising — projected 90% in ~3h"),
        (70.0, 10.0, 10.0, "stable", None, 50.0, 0, "attention", "CPU 20pp above average."),
        (20.0, 10.0, 10.0, "stable", None, 19.0, 2, "ok", "2 anomalies in the last 6h."),
        (20.0, 10.0, 10.0, "stable", None, 19.0, 1, "ok", "1 anomaly in the last 6h."),
        (0.0, 10.0, 10.0, "stable", None, 0.0, 0, "ok", "all within expected range."),
    ]
    df = spark.createDataFrame([c[:7] for c in cases],
                               "cpu_value double, mem_value double, disk_value double, mem_trend string, "
                               "mem_projection string, cpu_baseline double, anomalies6h long")
    df = df.withColumn("state", fleet.health_state()).withColumn("headline", fleet.headline())
    got = [(r.state, r.headline) for r in df.collect()]
    assert got == [(c[7], c[8]) for c in cases]


def test_severity_stems_cover_keywords():
    import re
    words = set()
    for _, pat in logtext.SEVERITY_CLASSES:
        body = re.sub(r"\\b|[()]", "", pat)
        for w in body.split("|"):
            words |= {w.replace("?", ""), re.sub(r"ING\?", "", w)} if "?" in w else {w}
    assert all(any(st in w for st in logtext.SEVERITY_STEMS) for w in words if w)
