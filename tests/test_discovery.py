"""Folders listed by tasks, and the rules over real trees."""

import os

import pytest

from loomspan.operators import discovery
from loomspan.sources.folders import read_folders


@pytest.fixture
def tree(tmp_path):
    for path in ("a/t1/e1/e1_hierarchy.json", "a/t1/e1/e1.json", "a/t1/e1/x.mp4", "a/t1/instruction.json", "a/t1/e2/y.mp4", "b/e3/e3_hierarchy.json", "b/e3/instruction.json", "top.mp4", ".hidden/z.mp4", "b/.secret"):
        (tmp_path / "one" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "one" / path).write_text("{}")
    (tmp_path / "one/a/t1/empty/deep").mkdir(parents=True)
    (tmp_path / "two").mkdir()
    os.symlink(tmp_path / "one/a", tmp_path / "two/again")
    return tmp_path


def test_every_folder_is_listed_empty_ones_too(spark, tree):
    rows = read_folders(spark, [f"{tree}/one", f"{tree}/none"]).collect()
    got = {r["folder"]: (r["depth"], r["files"]) for r in rows}
    assert got == {
        "": (0, ["top.mp4"]), "a": (1, []), "a/t1": (2, ["instruction.json"]), "a/t1/e1": (3, ["e1.json", "e1_hierarchy.json", "x.mp4"]), "a/t1/e2": (3, ["y.mp4"]), "a/t1/empty": (3, []), "a/t1/empty/deep": (4, []),
        "b": (1, []), "b/e3": (2, ["e3_hierarchy.json", "instruction.json"]),
    }
    assert {r["folder"] for r in read_folders(spark, [f"file://{tree}/one"], 2).collect()} == {"", "a", "a/t1", "b", "b/e3"}


def test_episodes_of_a_tree_are_found_once(spark, tree):
    one, two = (read_folders(spark, [f"{tree}/{r}"]) for r in ("one", "two"))
    found = {r["episode_key"]: (r["hierarchy"], r["instruction"], r["metadata"]) for r in discovery.hierarchies(one, "h").collect()}
    assert found == {"a/t1/e1": ("a/t1/e1/e1_hierarchy.json", "a/t1/instruction.json", "a/t1/e1/e1.json"), "b/e3": ("b/e3/e3_hierarchy.json", "b/e3/instruction.json", "b/e3/e3.json")}
    swept = {r["folder"]: (r["kind"], r["warnings"]) for r in discovery.media_sweep(one, "m", None, 3).collect()}
    assert swept == {"a/t1/e1": ("collection", ["media_sweep"]), "a/t1/e2": ("flat", ["media_sweep", "no_annotation_found", "no_metadata_json"]), "a/t1/empty": ("flat", ["media_sweep", "no_annotation_found", "no_metadata_json"])}
    jobs = discovery.interleaved([discovery.hierarchies(one, "h"), discovery.media_sweep(two, "m", None, None, 1)])
    got = {(r["source"], r["episode_key"], r["turn"]) for r in jobs.collect()}
    assert got == {("h", "a/t1/e1", 0), ("h", "b/e3", 1), ("m", "t1/e2", 1)}  # the other name of e1 has used a turn
    assert discovery.interleaved([discovery.hierarchies(one, "h"), discovery.media_sweep(two, "m")], 1).count() == 1


def test_inventories_are_the_same_for_any_order(spark, tree, tmp_path):
    jobs = discovery.interleaved([discovery.hierarchies(read_folders(spark, [f"{tree}/one"]), "h")])
    a = discovery.write_inventory(jobs, 3, f"file://{tmp_path}/x").collect()
    b = discovery.write_inventory(jobs.repartition(5).orderBy("real", ascending=False), 3, f"file://{tmp_path}/y").collect()
    assert sorted(a) == sorted(b) and sum(r["n"] for r in a) == 2
    nothing = read_folders(spark, [f"{tree}/none"])
    assert nothing.count() == 0 and discovery.interleaved([discovery.hierarchies(nothing, "h")]).count() == 0
