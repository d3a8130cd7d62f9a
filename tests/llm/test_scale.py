"""What moves between tasks grows with the input, also when most of it is one group."""

import random

from tilegrid.llm.neardup import near_duplicates


def _written(spark):
    """Bytes of shuffles by stage."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_one_group_of_distinct_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(220)]
    moved = {}
    for n in (5_000, 20_000):
        texts = set()
        while len(texts) < n:
            words = list(base)
            words[rng.randrange(220)] = f"x{rng.randrange(10**9)}"
            texts.add(" ".join(words))
        docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(sorted(texts))], "doc_id long, text string").repartition(4)
        before = _written(spark)
        rows = near_duplicates(docs).select("component_id").distinct().collect()
        assert [r.component_id for r in rows] == [1]
        moved[n] = sum(size for stage, size in _written(spark).items() if stage not in before)
    assert moved[20_000] < 4.6 * moved[5_000], moved
