import hashlib
import pathlib

from riskspark import io


def test_lines_are_joined_before_they_are_dealt(spark, tmp_path):
    """A file's lines are dealt in few pieces, each with the path once, and give the file's digest whatever the splits and batches."""
    texts = {"part-a.csv": b"a,b\n1,2\n" * 30_000, "part-b.csv": b"\n" * 25_000, "part-c.csv": b"\r\n\nend", "part-d.csv": bytes(range(256)) * 900 + b"\n", "part-e.csv": b"\n"}
    for name, data in texts.items():
        pathlib.Path(tmp_path, name).write_bytes(data)
    found = {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in texts.items()}
    for split, batch in (("64k", 1000), ("128m", 10_000)):
        confs = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1k", "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
        for k, v in confs.items():
            spark.conf.set(k, v)
        try:
            digests = io.file_digests(spark, str(tmp_path))
            assert {r.path.rsplit("/", 1)[1]: (r.sha256, r.bytes) for r in digests.collect()} == found
            assert digests._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # lines to pieces, pieces to digests
        finally:
            for k in confs:
                spark.conf.unset(k)
