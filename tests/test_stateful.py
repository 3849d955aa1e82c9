"""The event memory in batch and as a stream, and best-fit packing, against plain Python."""

from loomspan.operators.packing import best_fit_bins
from loomspan.plans.stateful import memory_bank, observations
from loomspan.sources.tables import table
from loomspan.streaming.memory import Memory, batch_memory, stream_memory


def test_commit_after_two_stable_steps():
    memory = Memory()
    steps = [("pick up cup", 85, ""), ("pick up cup", 95, ""), ("place cup", 0, ""), ("place cup", 5, "")]
    assert [memory.step(*s) for s in steps] == ["initialized", "active_stable", "transition_candidate", "transition_committed"]
    assert memory.committed == ["pick up cup"]


def test_announced_state_commits_and_flicker_does_not():
    memory = Memory()
    for s in [("a", 10, "b"), ("a", 20, ""), ("c", 0, ""), ("a", 20, ""), ("b", 0, ""), ("b", 1, "")]:
        last = memory.step(*s)
    assert (last, memory.committed) == ("transition_committed", ["a"])


def _expected(rows):
    out, memories = [], {}
    for r in sorted(rows, key=lambda r: (r["at"], r["caption"])):
        memory = memories.setdefault(r["key"], Memory())
        out.append((r["key"], r["at"], r["caption"], memory.step(r["caption"], r["progress"], r["following"]), memory.active.caption, memory.text(), memory.count))
    return sorted(out)


def test_batch_equals_python(spark, small):
    rows = observations(table(spark, small, "events")).collect()
    assert sorted(tuple(r) for r in memory_bank(spark, small).collect()) == _expected(rows)
    nothing = spark.createDataFrame([], "key string, at long, caption string, progress int, following string")
    assert batch_memory(nothing).count() == 0


def test_stream_equals_batch(spark, small, tmp_path):
    every = observations(table(spark, small, "events"))
    rows = sorted((tuple(r) for r in every.collect()), key=lambda r: r[1])
    for k in range(2):  # a file for each micro-batch, in order
        spark.createDataFrame(rows[k * 500 : (k + 1) * 500], every.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, at long, caption string, progress int, following string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_memory(source).writeStream.format("memory").queryName("bank").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert sorted(tuple(r) for r in spark.table("bank").collect()) == sorted(tuple(r) for r in memory_bank(spark, small).collect())


def test_best_fit(spark):
    items = spark.createDataFrame([(1, 6), (2, 5), (3, 5), (4, 4), (5, 25), (6, -1), (7, None), (8, 0)], "id long, n long")
    rows = {r["item"]: (r["length"], r["bin"]) for r in best_fit_bins(items, "id", "n", 10).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 8}
    assert rows[1][1] == rows[4][1] and rows[2][1] == rows[3][1] and rows[5][1] not in (rows[1][1], rows[2][1])


def test_states_are_the_same_by_canonical_caption_and_nothing_is_lost():
    memory = Memory()
    assert [memory.step(*s) for s in [("Pick up  cup.", 90, ""), ("pick up cup", 95, ""), ("", 1, ""), ("x", 101, ""), ("Place it", 0, ""), ("place it!", 5, "")]] == [
        "initialized", "active_stable", "refused", "refused", "transition_candidate", "transition_committed",
    ]
    for k in range(20):
        for _ in range(2):
            memory.step(f"state {k}", 90, "")
    assert memory.count == 20 and len(memory.shown) == 8 and memory.text().startswith("...>state 11>")


def test_bins_take_the_largest_that_fits():
    import random

    from loomspan.operators.packing import _bins

    r = random.Random(3)
    for _ in range(200):
        sizes = sorted((r.randrange(0, 14) for _ in range(r.randrange(1, 30))), reverse=True)
        got, left, number, want = _bins(sizes, 10), list(range(len(sizes))), 0, {}
        while left:
            room = None
            while left:
                fit = next((i for i in left if room is None or sizes[i] <= room), None)
                if fit is None:
                    break
                room = (10 if room is None else room) - sizes[fit]
                want[fit] = number
                left.remove(fit)
                if room < 0:
                    break
            number += 1
        assert got == [want[i] for i in range(len(sizes))]
