from cadenza.plans import signal_queries


def test_scan_has_all_window_sizes(spark, monkeypatch):
    records = spark.createDataFrame([("a", "ACDEFGHIKLMNPQRSTVWY" * 55)], "record_id string, sequence string")
    monkeypatch.setattr(signal_queries, "_sequences", lambda *_: records)
    rows = signal_queries.scan_sequence(spark, "").select("start", "end").collect()
    for size in (128, 256, 512, 1024):
        starts = sorted(r.start for r in rows if r.end - r.start == size)
        assert starts == sorted({*range(0, 1100 - size + 1, size // 4), 1100 - size})
