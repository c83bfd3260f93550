import math

import numpy as np
import pytest

from quern.llm import vectors


def brute(rows, threshold):
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = [set() for _ in rows]
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if la is None or la != lb or not fine(a) or not fine(b) or len(a) != len(b):
                continue
            x, y = np.array(a), np.array(b)
            if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], len(links[i]), min(rows[j][0] for j in seen)))
    return out


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(1)
    rows, centres = [], rng.normal(size=(12, 16))
    for i in range(300):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3, 0.5])
        rows.append((i, v.tolist(), int(rng.integers(3)) if i % 11 else None))
    odd = [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] * 16, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [-1.0, -2.0], [3.0] * 1500, [3.0] * 1499 + [3.5]]
    return rows + [(300 + i, v, 1) for i, v in enumerate(odd)] + [(400 + i, [1.0] * 16, 2) for i in range(20)]


@pytest.mark.parametrize("threshold", [0.93, 0.5])
@pytest.mark.parametrize("block", [2048, 16])
def test_against_brute_force(spark, made, threshold, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    got = vectors.link_vectors(df, threshold).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(made, threshold))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 33))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    codes, scale, length, error = vectors.quantise(x)
    about = vectors.products(codes, codes) * scale[:, None] * scale[None, :]
    assert (np.abs(about - x @ x.T) <= length[:, None] * error[None, :] + error[:, None] + 1e-12).all()


def test_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int, cls string, n int"
    assert vectors.link_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0], 1, "a", 1)] * 3 + [(None, [1.0, 0.0], 1, "b", 2), (7, None, None, None, None)]
    got = vectors.link_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == [("1", 3, 1)] * 3 + [("7", 0, 7), ("None", 3, 1)]
