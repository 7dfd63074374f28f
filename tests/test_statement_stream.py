"""Statement lines as a stream: any cut into batches, and a restart between them, gives the rows of the batch parser."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from test_pieces import statement

from tallyforge.operators import assembly, lines
from tallyforge.streaming import statements


@pytest.mark.parametrize("seed, stops", [(1, ()), (2, (2, 4))])
def test_stream_equals_batch(spark, tmp_path, seed, stops):
    rng = random.Random(seed)
    texts = {s: [*statement(rng, size), None] for s, size in (("x", 90), ("y", 5), ("z", 40))}
    rows = [(s, n, t) for s, mine in texts.items() for n, t in enumerate(mine)]
    folder, out, at = tmp_path / "in", str(tmp_path / "out"), dict.fromkeys(texts, 0)
    folder.mkdir()
    files = 6
    for i in range(files):  # each file has some next lines of each statement, in any order
        some = []
        for s, mine in texts.items():
            to = len(mine) if i == files - 1 else min(len(mine), at[s] + rng.randint(0, len(mine) // 4))
            some += [{"statement_id": s, "line_no": n, "text": mine[n]} for n in range(at[s], to)]
            at[s] = to
        rng.shuffle(some)
        (tmp_path / f"staged-{i}").write_text("\n".join(map(json.dumps, some)))

    def run():
        parsed = statements.parse_stream(statements.statement_lines(spark, str(folder)), F.lit(2026))
        q = parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    for i in range(files):
        (tmp_path / f"staged-{i}").rename(folder / f"lines-{i}.json")
        os.utime(folder / f"lines-{i}.json", (1_700_000_000 + i * 60,) * 2)  # files are read in order of age
        if i in stops:
            run()  # the query ends here and begins anew from its checkpoint
    run()
    found = assembly.dedupe_transactions(spark.read.parquet(out))
    expected = lines.parse_lines(spark.createDataFrame(rows, "statement_id string, line_no int, text string"), F.lit(2026))
    key = lambda df: sorted(map(str, df.select(sorted(expected.columns)).collect()))
    assert key(found) == key(expected) and expected.count() > 30
