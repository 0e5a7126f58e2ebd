"""Group trees: depth without a job per level, repeated ids, circles and lost parents."""

import random

from altloom.operators import groups

SCHEMA = "deck string, slide_idx int, shape_idx int, shape_id bigint, parent_id bigint"


def plain(rows):
    """Depth and path of every row by walking up from it."""
    by_place = {(r[0], r[1], r[2]): r for r in rows}
    out = {}
    for row in rows:
        path, at = [], row
        while at is not None and len(path) <= len(rows):
            path.append(at)
            if at[4] is None:
                break
            others = [r for r in rows if r[:2] == at[:2] and r[3] == at[4] and r[2] != at[2]]
            at = min(others, key=lambda r: r[2], default=None)
        if at is not None and at[4] is None:
            out[row[:3]] = (len(path) - 1, [r[3] for r in reversed(path)])
        else:
            out[row[:3]] = (None, [row[3]])
    assert len(by_place) == len(rows)
    return out


def found(spark, rows):
    return {(r.deck, r.slide_idx, r.shape_idx): (r.depth, r.path) for r in groups.flatten(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_repeated_ids_end(spark):
    rows = [("d", 0, 0, 5, None), ("d", 0, 1, 5, 5), ("d", 0, 2, 6, 5)]
    assert found(spark, rows) == {("d", 0, 0): (0, [5]), ("d", 0, 1): (1, [5, 5]), ("d", 0, 2): (1, [5, 6])}
    assert found(spark, [("d", 0, 0, 5, 5)]) == {("d", 0, 0): (None, [5])}
    assert found(spark, [("d", 0, 0, 5, 6), ("d", 0, 1, 6, 5), ("d", 0, 2, 7, 6)]) == {("d", 0, k): (None, [i]) for k, i in enumerate((5, 6, 7))}


def test_random_trees_equal_walking_up(spark):
    rng, rows = random.Random(4), []
    for slide in range(60):
        n = rng.randint(1, 25)
        for k in range(n):
            rows.append((f"d{slide % 3}", slide, k, rng.randint(0, n), None if rng.random() < 0.2 else rng.randint(0, n + 2)))
    assert found(spark, rows) == plain(rows)


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    written = []
    materialize = groups.materialize
    monkeypatch.setattr(groups, "materialize", lambda df: written.append(1) or materialize(df))
    depth = 10_000
    rows = [("d", 0, k, k, k - 1 if k else None) for k in range(depth)] + [("e", 0, 0, 1, 2), ("e", 0, 1, 2, 1)]
    flat = groups.flatten(spark.createDataFrame(rows, SCHEMA))
    assert len(written) <= 16
    last = flat.filter(f"deck = 'd' AND shape_idx = {depth - 1}").first()
    assert last.depth == depth - 1 and last.path == list(range(depth))
    assert flat.filter("deck = 'e' AND depth IS NULL AND size(path) = 1").count() == 2


def test_marks_go_up_and_suppression_goes_down(spark):
    rows = [("d", 0, 0, 5, None, "GROUP"), ("d", 0, 1, 5, 5, "GROUP"), ("d", 0, 2, 6, 5, "PICTURE"), ("d", 0, 3, 8, 8, "GROUP"), ("d", 0, 4, 9, 8, "PICTURE")]
    e = spark.createDataFrame([(*r, "", "none") for r in rows], SCHEMA + ", shape_type string, text string, fill_kind string")
    flat = groups.flatten(e)
    marked = {r.shape_idx: r.image_like for r in groups.is_image_like(e, flat).collect()}
    assert marked == {0: True, 1: False, 2: True, 3: False, 4: True}
    decided = e.selectExpr("deck", "slide_idx", "shape_idx", "shape_id", "IF(shape_type = 'GROUP', 'include_group', 'include_atomic') AS selector_decision", "'r' AS reason_code", "shape_idx = 2 AS human_alt")
    out = sorted((r.shape_idx, r.parent_group_id, r.selector_decision) for r in groups.suppress_children(decided, flat).collect())
    assert out == [
        (0, None, "include_group"), (1, 5, "exclude_redundant"), (2, 5, "exclude_redundant"), (2, 5, "preserve_conflict"),
        (3, None, "include_group"), (4, None, "include_atomic"),
    ]
