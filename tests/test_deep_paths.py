from pathlib import Path

import pyarrow.compute as pc
import pyarrow.parquet as pq

from folioflow.sources import readers


def test_whole_paths_of_few_landings_are_written(spark):
    base = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    n, before = 4500, set(base.iterdir())
    names = [f"{k * 7919 % 100003:06d}" for k in range(n)]
    beside = [(10000, 3000, "side"), (10001, 10000, None), (10002, 10001, "end"), (20000, 20001, "x"), (20001, 20000, "y"), (30000, 7, "leaf"), (40000, None, None), (40001, 40000, "low")]
    found = readers.folder_paths(spark.createDataFrame([(k, k - 1 if k else None, names[k]) for k in range(n)] + beside, "guid long, parent long, name string"))
    got = {r["guid"]: r["path"] for r in found.collect()}
    assert len(got) == n + 6 and all(got[k] == "/".join(names[: k + 1]) for k in range(n))
    assert got[10002] == "/".join(names[:3001]) + "/side/end" and got[10001] == got[10000]
    assert got[30000] == "/".join(names[:8]) + "/leaf" and got[40000] is None and got[40001] == "low"
    longest = 7 * n
    held = []
    for table in set(base.iterdir()) - before:
        sizes = pc.utf8_length(pq.read_table(table, columns=["path"])["path"])
        held.append(pc.sum(pc.filter(sizes, pc.greater(sizes, longest // 10))).as_py() or 0)
    assert max(held) < 10 * longest, max(held) / longest
