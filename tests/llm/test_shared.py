"""Scratch tables leave nothing behind but themselves."""

import time

from medgraph.llm import shared


def test_shuffle_files_go_with_the_query(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for path in blocks.getAllFiles().mkString("|").split("|") if (name := path.rsplit("/", 1)[-1]).startswith("shuffle_")}

    before, option = shuffled(), spark.conf.get(shared._CLEANUP)
    table = shared.saved(spark.range(1000).repartition(3, "id"), "some")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert spark.conf.get(shared._CLEANUP) == option
    assert sorted(r.id for r in table.collect()) == list(range(1000))
