"""Project pages: hidden parents and children, order, empty lists."""

import datetime

from waymark.operators import listings as I


def test_pages_show_what_the_user_sees(spark):
    projects = spark.createDataFrame([(1, "top", None), (2, "hidden", 1), (3, "leaf", 2), (4, "b child", 3), (5, "a child", 3), (6, "unseen child", 3), (7, "ring", 8), (8, "ring too", 7)], "project_id int, name string, parent_id int")
    visible = spark.createDataFrame([(k,) for k in (1, 3, 4, 5, 7, 7)], "project_id int")
    alignments = spark.createDataFrame([(3, 30, "B", 2, None, 0.0, 1.0, 2.0, 3.0), (3, 31, "A", 2, 30, -1.0, 1.5, 1.0, 9.0), (3, 32, "Z", 1, None, 0.0, 0.5, 0.0, 1.0), (2, 20, "x", 1, None, 0.0, 0.0, 0.0, 0.0)], "project_id int, alignment_id int, name string, priority int, parent_id int, w double, s double, e double, n double")
    legs = spark.createDataFrame([(30,), (30,), (32,)], "alignment_id int")
    day = lambda k: datetime.datetime(2026, 1, k)
    tracks = spark.createDataFrame([(3, 90, "old", day(1), 5.0), (3, 91, "undated", None, 6.0), (3, 92, "new", day(9), 7.0)], "project_id int, track_id int, name string, taken_at timestamp, length_m double")
    got = {r.project_id: r for r in I.project_pages(projects, visible, alignments, legs, tracks).collect()}
    assert set(got) == {1, 3, 4, 5, 7}
    leaf = got[3]
    assert [p.project_id for p in leaf.parents] == [1] and [c.name for c in leaf.children] == ["a child", "b child"]
    assert [(a.alignment_id, a.legs, a.parent_id) for a in leaf.alignments] == [(32, 1, None), (31, 0, 30), (30, 2, None)]
    assert [t.name for t in leaf.tracks] == ["new", "old", "undated"] and (leaf.w, leaf.s, leaf.e, leaf.n) == (-1.0, 0.5, 2.0, 9.0)
    assert got[4].alignments == got[4].tracks == got[4].children == [] and [p.project_id for p in got[4].parents] == [3, 1] and got[4].w is None
    assert got[1].children == [] and got[1].parents == [] and got[7].parents == []
