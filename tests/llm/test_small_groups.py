"""Outliers where a language has few documents."""

import random

from tests.llm.test_operators import SCHEMA, _plant
from tidemark.llm import outliers


def test_rare_languages_and_small_tables_are_judged(spark):
    rng = random.Random(22)
    sizes = lambda n: [rng.randint(100, 500) for _ in range(n)]
    rare = [(i + 5000, t, None, "b") for i, t in _plant(rng, sizes(12))]
    common = [(i, t, "en", "a") for i, t in _plant(rng, sizes(70))]
    clean = lambda rows: {r[0] for r in rows if r[0] % 5000 < 1000}
    for rows in (common + rare, [(i, t, "de", "c") for i, t in _plant(rng, sizes(30))]):
        out = outliers.judge(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(out) == len(rows) and not any(r.base_failed or r.distance is None for r in out)
        assert {r.doc_id for r in out if r.kept} == clean(rows)
