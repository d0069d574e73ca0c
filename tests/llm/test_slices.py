"""A benchmark of several slices: the same hits as by one automaton, one Python worker a task, one automaton at a time."""

import glob
import os
import random

from tessera.llm import decontaminate


def children():
    """Python processes that are Spark's workers, below this one."""
    own, parents = {os.getpid()}, {}
    for p in glob.glob("/proc/[0-9]*/stat"):
        try:
            text = open(p).read()
        except OSError:
            continue
        name, rest = text[text.index("(") + 1 : text.rindex(")")], text[text.rindex(")") + 2 :].split()
        parents[int(text.split()[0])] = (int(rest[1]), name)
    while more := {p for p, (up, _) in parents.items() if up in own} - own:
        own |= more
    return [p for p in own if p != os.getpid() and parents.get(p, (0, ""))[1].startswith("python")]


def test_many_slices(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for k in range(60)] + [(None, items_text := "alone beside all the others here"), ("e", None)]
    docs = []
    for d in range(80):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(items)[1] or ""
            text += own.upper().split() + [rng.choice(words)]
        docs.append((d, " ".join(text)))
    docs += [(None, items_text), (100, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    run = lambda: sorted((str(r.doc_id), r.text, tuple(map(str, r.benchmark_hits))) for r in decontaminate.mark(df.repartition(2), bench).collect())
    one = run()
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 300)
    for held in (1, 500, 1 << 20):
        monkeypatch.setattr(decontaminate, "HELD_BYTES", held)
        assert run() == one


def test_processes_do_not_grow_with_slices(spark, monkeypatch):
    """40 slices need no more Python workers than two."""
    bench = spark.createDataFrame([(str(i), " ".join(f"x{i}_{k}" for k in range(30))) for i in range(200)], "item_id string, text string")
    df = spark.range(2000).selectExpr("id AS doc_id", "concat('x', id % 200, '_0 some text ', repeat('word ', 20)) AS text").repartition(4)
    size = sum(len(r.text) for r in bench.collect())
    seen = []
    for n in (2, 40):
        monkeypatch.setattr(decontaminate, "SLICE_BYTES", size // n + 1)
        assert decontaminate.mark(df, bench).count() == 2000
        seen.append(len(children()))
    assert seen[1] <= seen[0] + 1
