from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest

from fathomlake.operators import text


@pytest.mark.parametrize("known", [0, 200_000])
def test_vectors_move_and_write_the_text_of_a_gram_once(spark, monkeypatch, known):
    """Written tables hold no grams, and the cells are those of plain counts."""
    draw = random.Random(4)
    rows = [(d, " ".join(f"w{draw.randrange(30)}" for _ in range(draw.randrange(40)))) for d in range(300)] + [(7, "w1 w2 again"), (None, "w1 only"), (900, None)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    written, write = [], text.durable
    monkeypatch.setattr(text, "durable", lambda x: (written.append(x.columns), write(x))[1])
    got = Counter((r["id"], r["index"], r["n"]) for r in text.posted_vectors(df, "id", "t", known=known).collect())
    assert written and not any("gram" in columns for columns in written)
    cells: Counter = Counter()
    for d, t in rows:
        w = (t or "").split()
        cells.update((d, g) for g in [*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))])
    totals: Counter = Counter()
    for (_, g), n in cells.items():
        totals[g] += n
    index = {g: i for i, g in enumerate(sorted(totals, key=lambda g: (-totals[g], g)))}
    assert got == Counter((d, index[g], n) for (d, g), n in cells.items())


@pytest.mark.parametrize("size", [1, 2, 5, 50])
def test_places_of_grams_do_not_depend_on_batches(monkeypatch, size):
    class Context:
        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(text.TaskContext, "get", lambda: Context)
    grams = [("a", 2), ("b", 1), ("b", 1), ("c", 2), ("d", 1), ("d", 1), ("d", 1), ("e", 9), ("f", 1)]
    table = pa.table({"gram": [g for g, _ in grams], "total": pa.array([n for _, n in grams], pa.int64()), "ids": [[i] for i in range(len(grams))], "ns": [[1]] * len(grams)})
    out = pa.Table.from_batches(list(text._placed(iter(table.to_batches(max_chunksize=size)))))
    assert out["at"].to_pylist() == [0, 0, 0, 1, 1, 1, 1, 0, 2] and out["fresh"].to_pylist() == [True, True, False, True, True, False, False, True, True]
    assert set(out["part"].to_pylist()) == {3} and out["ids"].to_pylist() == [[i] for i in range(len(grams))]
