"""Enclosure against a flood on a fine grid, and drawn cases."""

import collections
import random

import numpy as np

from ductwork.operators import zones

WALL = "id long, zone long, x1 double, y1 double, x2 double, y2 double, reach double"
POINT = "id long, x double, y double"


def flood(walls, slack, size=60.0, step=0.2):
    """Cells of a grid that can be reached from outside, if every wall's reach is changed by slack; the grid has a free margin."""
    n = int((size + 20) / step)
    x, y = np.meshgrid((np.arange(n) + 0.5) * step - 10, (np.arange(n) + 0.5) * step - 10)
    closed = np.zeros((n, n), bool)
    for _, _, ax, ay, bx, by, reach in walls:
        whole = (bx - ax) ** 2 + (by - ay) ** 2 or 1.0
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / whole, 0, 1)
        closed |= np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) <= reach + slack
    seen, todo = np.zeros((n, n), bool), collections.deque([(0, 0)])
    seen[0, 0] = True
    while todo:
        i, j = todo.popleft()
        for u, v in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
            if 0 <= u < n and 0 <= v < n and not seen[u, v] and not closed[u, v]:
                seen[u, v] = True
                todo.append((u, v))
    return lambda px, py: (bool(closed[int((py + 10) / step), int((px + 10) / step)]), bool(seen[int((py + 10) / step), int((px + 10) / step)]))


def test_enclosure_equals_a_flood(spark):
    r = random.Random(11)
    walls = []
    for k in range(105):
        x, y = r.uniform(5, 55), r.uniform(5, 55)
        walls.append((k, k // 2, x, y, min(58.0, max(2.0, x + r.uniform(-14, 14))), min(58.0, max(2.0, y + r.uniform(-14, 14))), r.choice([0.3, 0.6, 1.0])))
    points = [(k, r.uniform(0, 60), r.uniform(0, 60)) for k in range(400)]
    got = {x.id for x in zones.enclosed(spark.createDataFrame(points, POINT), spark.createDataFrame(walls, WALL), 500.0, 20.0).collect()}
    wide, narrow = flood(walls, 0.15), flood(walls, -0.15)
    sure = shut = 0
    for k, x, y in points:
        (closed, seen), (closed2, seen2) = wide(x, y), narrow(x, y)
        if closed or closed2 or seen != seen2:
            continue
        sure, shut = sure + 1, shut + (not seen)
        assert (k in got) == (not seen), (k, x, y)
    assert sure > 150 and 20 < shut < sure - 20


def test_drawn_enclosures(spark):
    box = lambda k, x, y, s, gap=0.0: [(4 * k, k, x, y, x + s - gap, y, 0.5), (4 * k + 1, k, x + s, y, x + s, y + s, 0.5), (4 * k + 2, k, x, y + s, x + s, y + s, 0.5), (4 * k + 3, k, x, y, x, y + s, 0.5)]
    walls = box(1, 0.0, 0.0, 20.0) + box(2, 100.0, 0.0, 20.0, 3.0) + box(3, 0.0, 100.0, 30.0) + box(4, 10.0, 110.0, 8.0, 4.0)
    points = [(1, 10.0, 10.0), (2, 110.0, 10.0), (3, 14.0, 114.0), (4, 5.0, 105.0), (5, 50.0, 50.0), (6, 0.2, 10.0), (7, None, 1.0), (1, 10.0, 10.0)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    odd = [*walls, walls[0], (99, 9, None, 0.0, 1.0, 1.0, 0.5)]
    got = sorted(tuple(x) for x in zones.enclosed(frame(points, POINT), frame(odd, WALL)).collect())
    assert got == [(1, 1, 1), (3, 1, 3), (4, 1, 3)]  # whole box; a box within a box counts by the outer one; 6 lies in a wall's reach
    assert zones.enclosed(frame([], POINT), frame(walls, WALL)).count() == 0
    assert zones.enclosed(frame(points, POINT), frame([], WALL)).count() == 0
    parts = {x.id: x.part for x in zones.unions(frame([*walls, (50, 8, 500.0, 0.0, 501.0, 0.0, 0.5)], WALL)).collect()}
    assert parts == {w[0]: w[0] // 4 * 4 for w in walls} | {50: 50}
