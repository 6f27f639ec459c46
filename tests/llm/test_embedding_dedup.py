import numpy as np
import pytest

from quernel.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, least):
    """Links by comparing all pairs, components by flooding."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if o else None for (_, v), o in zip(rows, ok)]
    n = len(rows)
    near = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    out = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min(rows[j][0] for j in seen)
        out[rows[i][0]] = (len(near[i]), c, c == rows[i][0])
    return out


@pytest.mark.parametrize("chunk", [7, 64])
def test_equals_brute_force(table, chunk):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array(rows[3][1]) + rng.normal(0, 0.1, 6)).astype(np.float32).tolist()) for i in range(40)]  # a dense group
    rows += [(200 + i, rows[5][1]) for i in range(5)]  # exact copies
    rows += [(300, None), (301, [0.0] * 6), (302, [float("nan")] + [1.0] * 5), (303, []), (304, [1.0, 0.0]), (305, [2.0, 0.0]), (306, [float("inf")] * 6), (307, [None] + [1.0] * 5)]
    got = E.cosine_components(table(rows, SCHEMA, ["component_id", "rep"]), least=0.9, chunk=chunk)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == brute(rows, 0.9)


def test_empty_null_ids_and_repeats(table):
    assert E.cosine_components(table([], SCHEMA)).count() == 0
    rows = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.1]), (None, [-1.0, 0.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in E.cosine_components(table(rows, SCHEMA)).collect())
    assert got == [(0, 0, 0, False), (0, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True)]
