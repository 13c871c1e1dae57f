import re
from pathlib import Path

import psutil

from threadloom.operators import vectors


def test_queries_in_blocks(spark, capfd):
    """More queries than a block holds give what one block gives, and no block is met by a shuffle join."""
    held = spark.range(120).selectExpr("id AS vec_id", "array(float(id % 7), float(id % 11), float(id % 5)) AS vec")
    asked = held.selectExpr("vec_id AS query_id", "vec AS qvec").where("query_id % 2 = 0")
    whole = sorted(tuple(r) for r in vectors.vector_knn(held, asked, 4).collect())
    got = vectors.vector_knn(held, asked, 4, most_queries=9)
    assert len(whole) == 240 and sorted(tuple(r) for r in got.collect()) == whole
    parts = {f.split("/block=")[1].split("/")[0] for f in got.inputFiles()}
    assert len(parts) == 7
    got.explain()
    assert "Join" not in capfd.readouterr().out


def test_a_task_holds_no_more_than_its_best(spark):
    """4,000 queries and 4,096 vectors, of which the first ones are all better than none yet."""
    rows = spark.range(4_096).repartition(1).selectExpr("id AS vec_id", "array(cast(hash(id) as double), cast(hash(id, 1) as double), cast(hash(id, 2) as double)) AS vec")
    asked = rows.where("vec_id < 4000").selectExpr("vec_id AS query_id", "vec AS qvec")
    assert vectors.vector_knn(rows, asked.where("query_id < 20"), 3).where("rank = 1 AND query_id = vec_id").count() == 20
    workers = lambda: [p.pid for p in psutil.Process().children(recursive=True) if "python" in p.name()]
    for pid in workers():
        Path(f"/proc/{pid}/clear_refs").write_text("5")  # peaks count from here
    assert vectors.vector_knn(rows, asked, 3).where("rank = 1 AND query_id = vec_id").count() == 4_000
    peak = lambda pid: int(re.search(r"VmHWM:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024
    assert max(map(peak, workers())) < 350
