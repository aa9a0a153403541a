"""Fixity of replicas."""

from pyspark.sql import functions as F

from photonlake.llm import merkle


def test_audit_finds_exactly_the_damage(spark):
    rows = [(i % 97 if i % 50 else None, f"http://x/{i}", f"<p>{i}</p>" * (i % 40)) for i in range(400)] + [(1, None, None), (1, "", ""), (7, "u", "é" * 90_000)]
    made = merkle.records(spark.createDataFrame(rows, "page_id long, url string, html string"), file_bytes=1 << 14).cache()
    assert made.count() == len(rows)
    spans = [tuple(r) for r in made.select("file", "offset", "length").orderBy("file", "offset").collect()]
    assert all(b[1] == a[1] + a[2] if a[0] == b[0] else b[1] == 0 for a, b in zip(spans, spans[1:]))
    a = made.select("file", "offset", "length", "sha256")
    assert {r["status"] for r in merkle.audit(a, a).collect()} == {"ok"}
    hit = [tuple(r) for r in a.where("offset > 500").orderBy("file", "offset").limit(5).select("file", "offset").collect()]
    gone, changed = hit[0], hit[3]
    at = lambda x: (F.col("file") == x[0]) & (F.col("offset") == x[1])
    extra = spark.createDataFrame([(0, 10**9, 5, "zz")], a.schema)
    b = a.where(~at(gone)).withColumn("sha256", F.when(at(changed), "00").otherwise(F.col("sha256"))).union(extra)
    got = {(r["file"], r["offset"]): r["status"] for r in merkle.audit(a, b).collect()}
    assert {k: v for k, v in got.items() if v != "ok"} == {gone: "missing", changed: "changed", (0, 10**9): "extra"}
    assert len(got) == len(rows) + 1


def test_empty_replicas(spark):
    none = merkle.records(spark.createDataFrame([], "page_id long, url string, html string")).select("file", "offset", "length", "sha256")
    assert merkle.audit(none, none).count() == 0
