"""Aliases, override targets and lifted references over three levels of composition."""

from quillon.operators import assets, prefabs

OBJ = "asset string, guid string, id long, class int, stripped boolean, name string"
REF = "asset string, id long, field string, guid string, target long"
PLACE = "asset string, id long, source_guid string, parent_guid string, parent_id long"
OVER = "asset string, placement long, pos int, guid string, id long, property string, value string, ref_guid string, ref_id long"


def test_three_levels(spark):
    objects = spark.createDataFrame(
        [("leaf", "gl", 1, 4, False, "Leaf"), ("leaf", "gl", 2, 114, False, "Part"), ("mid", "gm", 7, 4, False, "Mid"), ("mid", "gm", 8, 114, True, None), ("top", "gt", 9, 4, False, "Top"), ("top", "gt", 5, 114, True, None), ("top", "gt", 6, 114, True, None), ("twin", "gw", 3, 1, False, "Twin"), ("code", "gc", 11, 115, False, "Code")],
        OBJ,
    )
    refs = spark.createDataFrame(
        [("leaf", 1, "m_Father", "", 0), ("leaf", 2, "owner", "", 1), ("leaf", 2, "m_Script", "gc", 11), ("leaf", 2, "to_mid", "gm", 7), ("leaf", 2, "list.Array.data[0]", "", 1), ("leaf", 2, "list.Array.data[1]", "", 2), ("mid", 7, "sees", "", 8), ("top", 9, "a", "", 5), ("top", 9, "b", "", 6), ("top", 9, "lost", "gone", 4)],
        REF,
    )
    placements = spark.createDataFrame([("mid", 70, "gl", "", 7), ("top", 90, "gm", "", 0), ("twin", 30, "gl", "", 0), ("twin", 31, "gl", "", 0), ("outer", 40, "gw", "", 0)], PLACE)
    objects = objects.unionByName(spark.createDataFrame([("outer", "go", 1, 1, False, "Outer")], OBJ))
    overrides = spark.createDataFrame(
        [
            ("mid", 70, 0, "gl", 2, "list.Array.size", "1", None, None), ("top", 90, 0, "gl", 2, "owner", "", "", 9), ("top", 90, 1, "gl", 2, "m_Script", "", "gt", 9), ("top", 90, 2, "gl", 2, "extra", "", "gm", 7), ("top", 90, 3, "gl", 2, "none", "", None, 0), ("top", 90, 4, "gl", 99, "owner", "", "", 9),
            ("top", 90, 5, "gl", 2, "list.Array.data[3]", "", "", 9), ("top", 90, 6, "gl", 2, "list.Array.size", "4", None, None), ("top", 90, 7, "gl", 2, "list.Array.size", "3", None, None), ("top", 90, 8, "gl", 2, "list.Array.data[2]", "", "", 9), ("outer", 40, 0, "gl", 2, "owner", "", "", 1),
        ],
        OVER,
    )
    removals = spark.createDataFrame([], "asset string, placement long, guid string, id long")
    composed = assets.compose(objects, placements, overrides, removals)
    stripped = spark.createDataFrame([("mid", 8, 70, "gl", 2), ("top", 5, 90, "gl", 2), ("top", 6, 90, "", 8)], "asset string, id long, placement long, guid string, target long")
    known = prefabs.aliases(objects, stripped, placements, composed)
    assert {(r.asset, r.id, r.path) for r in known.where("asset in ('mid', 'top')").collect()} == {("mid", 7, "7"), ("mid", 8, "70/2"), ("top", 9, "9"), ("top", 5, "90/70/2"), ("top", 6, "90/70/2")}
    hit = {(r.asset, r.pos): r.path for r in prefabs.override_targets(overrides, objects, placements, composed, known).collect()}
    assert hit["mid", 0] == "70/2" and hit["top", 0] == "90/70/2" and hit["top", 4] is None and hit["outer", 0] is None  # two instances: not unique
    got = {}
    for r in prefabs.references(objects, refs, placements, overrides, composed, known).collect():
        assert (r.path, r.field) not in got.setdefault(r.asset, {})
        got[r.asset][r.path, r.field] = (r.to, r.object)
    assert got["leaf"] == {("1", "m_Father"): (None, None), ("2", "owner"): ("leaf", "1"), ("2", "m_Script"): ("code", "11"), ("2", "to_mid"): ("mid", "7"), ("2", "list.Array.data[0]"): ("leaf", "1"), ("2", "list.Array.data[1]"): ("leaf", "2")}
    assert got["mid"] == {("7", "sees"): ("mid", "70/2"), ("70/1", "m_Father"): ("mid", "7"), ("70/2", "owner"): ("mid", "70/1"), ("70/2", "m_Script"): ("code", "11"), ("70/2", "to_mid"): ("mid", "7"), ("70/2", "list.Array.data[0]"): ("mid", "70/1")}
    assert got["top"] == {
        ("9", "a"): ("top", "90/70/2"), ("9", "b"): ("top", "90/70/2"), ("9", "lost"): (None, None), ("90/7", "sees"): ("top", "90/70/2"), ("90/70/1", "m_Father"): ("top", "90/7"), ("90/70/2", "owner"): ("top", "9"), ("90/70/2", "m_Script"): ("top", "9"),
        ("90/70/2", "to_mid"): ("top", "90/7"), ("90/70/2", "list.Array.data[0]"): ("top", "90/70/1"), ("90/70/2", "extra"): ("mid", "7"), ("90/70/2", "list.Array.data[2]"): ("top", "9"),
    }
    assert got["outer"]["40/30/2", "owner"] == ("outer", "40/30/1") and got["outer"]["40/31/2", "owner"] == ("outer", "40/31/1")
