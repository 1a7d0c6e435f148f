"""Near copies just below the threshold: the join connects the closest first."""

import random

from larder.llm import components, jaccard_join
from llm.test_training_data import brute_components


def test_near_copies_below_the_threshold_make_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(240):
        doc = list(base)
        for at in rng.sample(range(5, 145), 2):
            doc[at] = f"x{rng.randrange(8)}"
        texts.append((i, " ".join(doc)))
    compared, linked = [], jaccard_join._linked

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return linked(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_linked", counted)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, size=5, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 5, 80)
    last = compared[-len(jaccard_join.PASSES) :]
    assert sum(last) < 200


def test_small_steps_take_few_tasks_and_files(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        doc = list(base) if i % 2 else [f"{i}v{j}" for j in range(30)] + base[:30]
        doc[rng.randrange(5, 25)] = f"x{rng.randrange(40)}"
        texts.append((i, " ".join(doc)))
    files = {}

    def counted(store):
        def materialise(df, name):
            stored = store(df, name)
            files[name] = max(files.get(name, 0), len(stored.inputFiles()))
            return stored

        return materialise

    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    monkeypatch.setattr(components, "materialise", counted(components.materialise))
    monkeypatch.setattr(jaccard_join, "materialise", counted(jaccard_join.materialise))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(jaccard_join, "prepare", lambda s: s)
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        got = jaccard_join.jaccard_components(docs, size=3, percent=80).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 3, 80)
    most = 2 * spark.sparkContext.defaultParallelism
    small = {k: n for k, n in files.items() if k not in ("jaccard-sharing", "jaccard-met")}
    assert {"component-edges", "components", "jaccard-links", "jaccard-placed", "jaccard-named"} <= set(small)
    assert max(small.values()) <= most, small
