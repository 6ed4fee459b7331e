"""What a task leaves behind in a worker that later stages use too."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from dwellspark.llm import decontaminate, packing, pretokens, shared


def test_a_finished_task_gives_memory_back(spark, monkeypatch):
    done, tasks = [], []
    df = spark.range(1)
    monkeypatch.setattr(pretokens, "give_back", lambda: done.append(True))
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: tasks.append(run))
    shared.in_arrow(df, lambda batches: (b for b in batches), "id bigint")
    rows = tasks[0](iter([1, 2]))
    assert [next(rows), next(rows), done] == [1, 2, []]
    assert list(rows) == [] and done == [True]


def test_words_are_forgotten_after_a_task(spark, monkeypatch):
    tasks = []
    df = spark.range(1).withColumn("text", F.lit("x"))
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: tasks.append(run))
    decontaminate.windows(df, "id", "text")
    list(tasks[0](iter([pa.RecordBatch.from_pydict({"key": [1], "same": [2], "text": ["one two three four five six seven eight nine ten"]})])))
    assert decontaminate.word_facts.cache_info().currsize == 0


def test_packing_remembers_fewer_pieces():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert pretokens.known(path, packing.MOST_KNOWN).most < pretokens.Known.MOST == pretokens.known(path).most
